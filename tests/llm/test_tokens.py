import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epivigil.llm import packing, simple8b, token_counts, token_files
from epivigil.llm.encoding import Encoder
from epivigil.session import new_path

from .frames import TEXTS, no_documents, odd_documents

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(ids):
    assert simple8b.decode(simple8b.encode(ids)).tolist() == ids


def test_simple8b_blocks():
    v = (np.random.default_rng(5).random(20_000) ** 3 * 49_000).astype(np.uint64)
    data = simple8b.encode(v)
    assert len(data) < 2.5 * len(v)
    for first in range(5):
        assert (simple8b.decode(data, first, 2) == v[first * 4096 : (first + 2) * 4096]).all()


PIECES = ["a", "B", "é", "ß", " ", " ", "\n", ".", ",", "'s", "'", "-", "_", "1", "23", "|", "%%%", "don't", "I'LL", "\t", "(", "<|endoftext|>", "日", "  ", "\0", "²"]


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(deadline=None, max_examples=60)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), max_size=8))
def test_encoder_equals_library(path, texts):
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, 7, most=40)  # forgets often
    e = _ENCODERS[path]
    ids, n = e.encode(texts)
    assert len(n) == len(texts)
    at = np.concatenate([[0], np.cumsum(n)]).astype(int)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [7]


_ENCODERS: dict = {}


def brute_ids(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


def test_token_files(spark):
    path = new_path(spark, "test-files")
    token_files.write(odd_documents(spark), path, WORD, 1, shards=3)
    expected, start = [], 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = brute_ids(WORD, t, 1)
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == expected
    arrays = {r["start"]: r["ids"] for r in token_files.read_ids(spark, path).collect()}
    assert arrays[0] == brute_ids(WORD, None, 1) and len(arrays) == len(TEXTS)


def test_no_token_files(spark):
    path = new_path(spark, "test-files")
    token_files.write(no_documents(spark), path, WORD, 1, shards=2)
    assert token_files.read_digests(spark, path).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sampled_from(["word ", "é", " ", "\n", "x" * 30, "日本", "a b c", "1 2", "\t", "▁", "longer words here. "]), max_size=80).map("".join))
def test_counts_of_cut_texts(text):
    if "c" not in _ENCODERS:
        _ENCODERS["c"] = token_counts.Counter(PIECE, 40, 6)
    c = _ENCODERS["c"]
    assert c.keeps_text and c.space_breaks
    assert c.count(text) == len(c.model.encode(text))


def test_token_counts(spark, sf):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for docs in (odd_documents(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        got = token_counts.token_counts(docs, PIECE, chunk=600, overlap=32).collect()
        key = lambda x: tuple((v is not None, v) for v in x)
        expected = [(i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts]
        assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert token_counts.token_counts(no_documents(spark), PIECE).count() == 0


def check_packing(rows, items, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(r["length"] for r in rows) == sorted(items)
    return len(by)


def best_fit_decreasing(items, capacity):
    gaps = []
    for x in sorted(items, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit if fit is not None else capacity) - x)
    return len(gaps)


@pytest.mark.parametrize("kind", ["mixed", "tiny", "hot", "halves", "full"])
def test_pack_is_as_good_as_best_fit(spark, kind):
    rng = np.random.default_rng(2)
    items = {
        "mixed": rng.integers(1, 101, 400), "tiny": rng.integers(1, 4, 500), "hot": np.where(rng.random(400) < 0.5, 37, rng.integers(1, 90, 400)),
        "halves": rng.integers(45, 56, 300), "full": np.full(20, 100),
    }[kind].tolist()
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(items)], "doc_id long, piece int, length long")
    used = check_packing(packing.pack(df, ["doc_id", "piece"], capacity=100).collect(), items, 100)
    assert used <= best_fit_decreasing(items, 100) * 1.02 + 1 and used >= -(-sum(items) // 100)


def test_pieces_and_packing_of_odd_documents(spark):
    cut = packing.pieces(odd_documents(spark), BYTE, 2, 64, with_ids=True)
    ids = {}
    for r in cut.orderBy("piece").collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 64 or r["piece"] == 0
        ids.setdefault(r["doc_id"], []).append(r["ids"])
    for i, t in dict(x for x in TEXTS if x[0] not in (None, 1)).items():
        assert sum(ids[i], []) == brute_ids(BYTE, t, 2)
    rows = packing.pack(cut.drop("ids"), ["doc_id", "piece"], capacity=64).collect()
    check_packing(rows, [r["length"] for r in cut.select("length").collect()], 64)
    whole = packing.packed_ids(odd_documents(spark), BYTE, 2, 64)
    assert whole.agg(F.sum(F.size("ids"))).first()[0] == sum(len(brute_ids(BYTE, t, 2)) for _, t in TEXTS)


def test_pack_of_nothing_and_of_wrong_lengths(spark):
    assert packing.pack(packing.pieces(no_documents(spark), BYTE, 2), ["doc_id", "piece"]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2000)], "doc_id long, length long"), ["doc_id"])
