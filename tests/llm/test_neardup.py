import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epivigil.llm import neardup
from epivigil.llm.components import components

from .frames import TEXTS, no_documents, odd_documents


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts, percent):
    """Component and set size of each (id, text); ids are distinct."""
    sets = {i: shingles(t) for i, t in texts}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def crowd():
    """Copies, near copies on both sides of the threshold, chains, shared passages, short texts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out, base = [], [word() for _ in range(120)]
    for k in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    for k in range(40):  # two edits on common places: links beside the centre
        w = list(base)
        for at in rng.sample((10, 12, 50, 53, 90), 3):
            w[at] = ("other", "words")[at % 2] if rng.random() < 0.7 else word()
        out.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for k in range(12):  # each is near the next one only
        chain = chain[2:] + [word(), word(), word()]
        out.append(" ".join(chain))
    passage = " ".join(word() for _ in range(40))
    out += [f"{passage} {' '.join(word() for _ in range(rng.randint(2, 60)))}" for _ in range(40)]
    out += ["One two", "one TWO", "one two three", "", " ", "É é", "é é", "x"] + out[:5]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("percent", [85, 80, 70])
def test_components_equal_brute_force(spark, percent):
    texts = crowd()
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), percent).collect()
    expected = brute(texts, percent)
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == expected


def test_odd_documents(spark):
    rows = neardup.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["component_id"] == 1 for i in (1, 2, 3) for r in by[i]) and all(r["kept"] for r in by[1])
    assert sorted(((r["component_id"] or 0), r["kept"]) for r in by[None]) == [(0, True), (1, False)]
    assert by[8][0]["component_id"] == 7 and by[11][0]["component_id"] == 10
    assert by[4][0]["n_shingles"] == 0 and by[5][0]["component_id"] == 5 and by[6][0]["kept"]
    assert neardup.near_duplicates(no_documents(spark)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for size in (3, 20, 400):
        same = []
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            b = np.unique(np.concatenate([a[: size - size // 5], rng.integers(0, 2**63, size // 5, dtype=np.uint64)]))
            union = len(np.union1d(a, b))
            same.append((neardup.signature(a) == neardup.signature(b)).mean() - len(np.intersect1d(a, b)) / union)
        assert abs(np.mean(same)) < 0.05
    one = neardup.signature(np.array([12345], np.uint64))
    assert (one == 12345).all()


def test_shingler_sets():
    texts = [t for _, t in TEXTS] + ["a b c d e f a b c d e", "A\x0bB\x0cc\rd  e"]
    got = neardup.Shingler(width=5).sets(pa.array(texts))
    again = neardup.Shingler().sets(pa.array(texts))
    parts = neardup.Shingler().sets(pa.array(texts).slice(0, 9)) + neardup.Shingler().sets(pa.array(texts).slice(9))
    for t, s, r, p in zip(texts, got, again, parts):
        assert len(s) == len(shingles(t)) and (s == r).all() and (s == p).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (7, 300), (300, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["comp"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {300: 0} | {i: 100 for i in range(100, 160)}
    assert components(df.limit(0)).count() == 0


def test_distinct_ids_are_the_smallest_of_their_component(spark, sf):
    out = neardup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    assert out.where("component_id > doc_id").count() == 0 and out.agg(F.countDistinct("component_id")).first()[0] == out.where("kept").count()


def test_members_of_an_edited_centre_are_not_paired_off(spark, monkeypatch):
    """The centre's own edits are in every member's difference; they come last, so few pairs are compared."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    edited = list(base)
    for at in (20, 60, 100, 140):
        edited[at] = "centre"
    texts = [(0, " ".join(edited))]
    for k in range(1, 81):
        w = list(base)
        for at in rng.sample(range(200), 3 if k % 2 else 6):
            w[at] = f"x{k}-{at}"
        texts.append((k, " ".join(w)))
    compared, before = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name=None: compared.append((name, r := before(df, name))) or r)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 80).collect()}
    assert got == brute(texts, 80)
    assert sum(df.count() for name, df in compared if name == "pairs") < 4 * len(texts)
