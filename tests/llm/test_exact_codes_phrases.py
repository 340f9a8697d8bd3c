import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from epivigil.llm import collocations, exact_dedup, vector_codes

from .frames import TEXTS, no_documents, odd_documents

SF = "/root/testdata/sf0.01"


# exact duplicates


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def check_groups(rows, docs):
    """``rows`` of the operator against (doc_id, text) of its documents."""
    groups = {}
    for i, t in docs:
        groups.setdefault(plain(t), []).append(i)
    assert len(rows) == len(docs)
    left = Counter((i, hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in docs)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    stays = Counter()
    for r in rows:
        left[r["doc_id"], r["text_sha256"]] -= 1
        ids = by_sha[r["text_sha256"]]
        keep = min((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (keep, len(ids))
        assert not r["kept"] or r["doc_id"] == keep
        stays[r["text_sha256"]] += r["kept"]
    assert not +left and set(stays.values()) <= {1} and len(stays) == len(groups)


def test_equal_texts(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("ab \t\n") for _ in range(100))
    texts = ["a b", "a\tb", "a \n b", "a b ", " a b", "", None, " ", "\t\x0b", "a b", "é" * 30, long, long.replace(" ", "\n\n"), long[:-1], long + "x", long[:50] + "c" + long[51:]]
    docs = [(rng.choice([i, i, i + 100, None]), rng.choice(texts)) for i in range(150)]
    for block in (7, 64):
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        check_groups(exact_dedup.exact_duplicates(frame, block).collect(), docs)


def test_equal_texts_of_odd_documents(spark):
    check_groups(exact_dedup.exact_duplicates(odd_documents(spark)).collect(), TEXTS)
    assert exact_dedup.exact_duplicates(no_documents(spark)).count() == 0


def test_crowds_are_named_in_parts(spark):
    """Keys that most rows hold, at the leaves and in pairs."""
    docs = [(i, "same text of many " * 4 + ("end" if i % 3 else f"end {i % 7}")) for i in range(2000)] + [(5000 + i, f"own {i}") for i in range(50)]
    check_groups(exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), 40).collect(), docs)


def test_names_stand_for_keys(spark):
    keys = [(i, (i * i) % 11 if i % 5 else None, str(i % 3)) for i in range(300)] + [(1000 + i, 1, "1") for i in range(900)]
    named = exact_dedup.name_keys(spark.createDataFrame(keys, "uid long, x long, y string"), ["x", "y"], "test-names").collect()
    smallest = {}
    for uid, x, y in keys:
        smallest[x, y] = min(uid, smallest.get((x, y), uid))
    assert {r["uid"]: r["name"] for r in named} == {uid: smallest[x, y] for uid, x, y in keys}


def test_exact_dedup_runs_without_python_workers(spark, sf):
    plan = exact_dedup.name_keys(exact_dedup._blocks(spark.read.parquet(f"{sf}/documents.parquet"), 2048), ["block"], "test-plan")
    blocks = exact_dedup._blocks(spark.read.parquet(f"{sf}/documents.parquet"), 2048)
    text = blocks._jdf.queryExecution().executedPlan().toString() + plan._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in text and "Python" not in text


# vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(256 * np.longdouble(x))) if abs(x) < 1e15 else int(x) * 256 for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = -(-len(kept[0][1]) // parts)
    cut = lambda v: [(v + [0] * (parts * width - len(v)))[k * width : (k + 1) * width] for k in range(parts)]
    books = [[cut(v)[k] for _, v, _ in kept[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda k, p: min((far(p, e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(k, cut(v)[k])[1], []).append(cut(v)[k])
            new.append([[sum(c) // len(c) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(books[k])])
        books = new
    out = {}
    for i, v, label in kept:
        found = [near(k, p) for k, p in enumerate(cut(v))]
        out[i] = ("".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def check_codes(spark, rows, parts, entries, rounds, kind="array<double>"):
    got = vector_codes.vector_codes(spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").repartition(3), parts, entries, rounds).collect()
    expected, digest = brute_codes(rows, parts, entries, rounds)
    assert len(got) == len(expected)
    of_label = Counter()
    for _, error, label in expected.values():
        of_label[label] += error
    for r in got:
        code, error, label = expected[r["vec_id"]]
        assert (r["code"], r["codebooks_sha256"]) == (code, digest)
        assert r["error"] == (error if error < 1 << 63 else None)
        assert r["label_error"] == (of_label[label] if of_label[label] < 1 << 63 else None)


@pytest.mark.parametrize("dims, parts, entries", [(8, 2, 3), (13, 4, 6), (6, 2, 40), (3, 5, 4)])
def test_codes_equal_brute_force(spark, dims, parts, entries):
    rng = random.Random(dims)
    vector = lambda: [rng.choice([rng.gauss(0, 1), 0.5, -0.5, 0.0]) for _ in range(dims)]
    rows = [(i, vector(), rng.choice([None, 1, 2])) for i in rng.sample(range(-50, 500), 90)] + [(None, vector(), 3)]
    rows += [(900, None, 1), (901, [None] + [0.0] * (dims - 1), 1), (902, [float("nan")] * dims, 1), (-99, [float("inf")] * dims, 1), (903, rows[0][1], 2)]
    check_codes(spark, rows, parts, entries, 2)


def test_codes_of_large_numbers_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1.0, -1.0, 3.0]) * 2.0 ** rng.choice([0, 20, 40, 60, 90, 900]) + rng.random() for _ in range(4)], i % 2) for i in range(30)]
    check_codes(spark, rows, 2, 4, 2)


def test_codes_of_odd_tables(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("error", T.StringType())])
    rows = [(3, [1.0, 2.0], None, "x", "y"), (1, [0.0], 1, "x", "y"), (1, [0.0], 1, "x", "y"), (2, [], 1, "x", "y"), (None, [5.0], None, "x", "y")]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, schema), 2, 4, 1).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"], r["error"]) for r in got) == [(False, 1, 0), (False, 1, 0), (True, None, 0)]
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame(rows[3:4], schema)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(1, 20), st.sampled_from([3, 1000, 2**40, 2**70]), st.integers(0, 10**6))
def test_nearest_equals_plain_distances(width, entries, rows, size, seed):
    rng = random.Random(seed)
    kind = np.int64 if size < 2**48 else object
    make = lambda n: np.array([[rng.randint(-size, size) for _ in range(width)] for _ in range(n)], kind).reshape(n, width)
    x, e = make(rows), make(entries)
    at, far = vector_codes.nearest(x, e)
    for r in range(rows):
        expected = min((sum((int(a) - int(b)) ** 2 for a, b in zip(x[r], e[j])), j) for j in range(entries))
        assert (int(far[r]), int(at[r])) == expected


def test_hadamard_rows_stand_in_sequency_order():
    h = vector_codes.hadamard(16)
    assert (h @ h.T == 16 * np.eye(16)).all() and [(np.diff(r) != 0).sum() for r in h] == list(range(16))


# phrases


def brute_phrases(rows, top, least, covered):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found, inside = [], {}
        for q, b in f.items():
            if b >= least:
                for m in range(2, len(q)):
                    for i in range(len(q) - m + 1):
                        inside[q[i : i + m]] = max(b, inside.get(q[i : i + m], 0))
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if p in inside and 100 * inside[p] >= covered * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made_texts(seed, rows=220):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(14)] + ["é", "Ü", "A", "b|", "..", "日本"]
    fixed = [[rng.choice(words) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    texts = []
    for _ in range(rows):
        parts = [" ".join(rng.choice(fixed) if rng.random() < 0.5 else rng.choices(words, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 6))]
        texts.append((rng.choice(["en", "en", "fr", None]), rng.choice([" ", "  ", "\t", ". ", "\n", ", ", "\x0b"]).join(parts)))
    return texts + [("en", None), ("en", ""), (None, "\t \n"), ("de", "x" * 5000)]


@pytest.mark.parametrize("seed, top, least, covered, batch", [(1, 5, 3, 80, 3), (2, 12, 2, 60, 20)])
def test_phrases_equal_brute_force(spark, seed, top, least, covered, batch):
    rows = made_texts(seed)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.phrases(frame, top, least, covered, batch, bits=10)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_phrases(rows, top, least, covered)


def test_few_places_of_a_whole_table(spark):
    """Pruned search against the first rows of the full result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {(r["lang"], r["rank"]): tuple(r) for r in collocations.phrases(docs, least=10).collect()}
    few = collocations.phrases(docs, top=40, least=10, first_batch=60).collect()
    assert {(r["lang"], r["rank"]): tuple(r) for r in few} == {k: v for k, v in whole.items() if k[1] <= 40}


def test_phrases_of_odd_documents(spark):
    got = collocations.phrases(odd_documents(spark), top=30, least=2)
    expected = brute_phrases([("en" if t else None, t) for _, t in TEXTS], 30, 2, 80)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == expected
    assert collocations.phrases(no_documents(spark)).count() == 0


def test_tokens_of_slices():
    texts = pa.array(["zz zz", "One two.Three", None, " ", "four", "É five"])
    tokens = collocations.Tokens(texts.slice(1), pa.array(["a", "b", "a", "c", "a"]))
    assert tokens.words.take(pa.array(tokens.code)).to_pylist() == ["one", "two", "three", "four", "É", "five"]
    assert tokens.starts(2).tolist() == [0, 4]


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = (1 << 62) + 12345
    row = spark.createDataFrame([(big, big + 7, big + 9)], "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row["s"] == 2000000 * big // (2 * big + 16)
