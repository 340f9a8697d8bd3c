import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from epivigil.llm import decontaminate, language, quality_model, quality_rules, queries, toxicity, vectors
from epivigil.llm.common import bounded_sample, held_out, slices

from .frames import TEXTS, no_documents, odd_documents
from .test_neardup import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out(docs):
    for r in docs.select("doc_id", held_out().alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_bounded_sample(spark, docs):
    got = bounded_sample(docs, ["lang"], 50, "doc_id", "x").groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"de": 50, "en": 50, "es": 50, "fr": 50}
    assert bounded_sample(docs, ["lang"], 10_000, "doc_id", "x").count() == docs.count()


def test_language_on_held_out_rows(spark, docs):
    out = queries.op6_language_id(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    mine = [r for r in out if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in mine]) > 0.97
    assert np.mean([r["rejected"] for r in out]) < 0.01


def test_language_of_odd_documents(spark, docs):
    model = language.train(docs, most=60)
    out = language.predict(odd_documents(spark), model).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert r["score"] > 0 or r["rejected"]
    assert language.predict(no_documents(spark), model).count() == 0
    nothing = language.predict(odd_documents(spark), language.train(no_documents(spark))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and all(r["rejected"] for r in nothing)


def auc(rows, label):
    rows = sorted(rows, key=lambda r: r["score"])
    rank = np.arange(1, len(rows) + 1)
    y = np.array([r[label] for r in rows])
    return (rank[y == 1].mean() - (y == 1).sum() / 2 - 0.5) / (y == 0).sum()


@pytest.mark.parametrize("name,label,least", [("op7_toxicity", "toxic", 0.75), ("op9_quality_classifier", "quality", 0.95)])
def test_classifiers_on_held_out_rows(spark, docs, labels, name, label, least):
    out = entry.queries()[name](spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == docs.count() and out.where("score < 0 or score > 1").count() == 0
    bound = 0.5 if label == "toxic" else 0.3
    assert out.where(F.col("predicted") != (F.col("score") >= bound).cast("int")).count() == 0
    assert auc(out.where("held_out").join(labels, "doc_id").collect(), label) > least


def test_classifiers_read_no_label_of_held_out_rows(spark, docs, labels):
    turned = labels.withColumns({c: F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("toxic", "quality")})
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a.features == b.features).all() and (a.weights == b.weights).all()
    a, b = quality_model.train(docs, labels, epochs=1), quality_model.train(docs, turned, epochs=1)
    assert (a.vectors == b.vectors).all() and (a.out == b.out).all()


def test_classifiers_of_odd_documents(spark, docs, labels):
    for module in (toxicity, quality_model):
        for told in (labels, labels.limit(0)):
            model = module.train(docs, told)
            assert module.predict(odd_documents(spark), model).count() == len(TEXTS)
            assert module.predict(no_documents(spark), model).count() == 0
        module.predict(odd_documents(spark), module.train(no_documents(spark), labels)).collect()


def test_risk_is_not_negative_learning():
    rng = np.random.default_rng(0)
    x = (rng.random((4000, 6)) < 0.1).astype(float)
    toxic = (x[:, 0] + x[:, 1]) > 0
    confirmed = toxic & (rng.random(4000) < 0.3)
    w, b = toxicity._fit(np.vstack([x[confirmed], x]), np.r_[np.ones(confirmed.sum(), bool), np.zeros(4000, bool)], toxic.mean(), 400, 0.05, 1e-4)
    assert ((x @ w + b > 0) == toxic).mean() > 0.97


def test_risk_gradient_equals_finite_differences():
    """Steps of the fit against steps with a numeric gradient of the class-prior-corrected risk, on both sides of its bound at 0."""
    rng = np.random.default_rng(3)
    for prior in (0.2, 0.7):
        x = (rng.random((40, 4)) < 0.4).astype(float)
        positive = (x[:, 0] > 0) & (rng.random(40) < 0.8)
        z = lambda w, a: a @ w[:-1] + w[-1]
        parts = lambda w: (prior * np.log1p(np.exp(-z(w, x[positive]))).mean(), np.log1p(np.exp(z(w, x[~positive]))).mean() - prior * np.log1p(np.exp(z(w, x[positive]))).mean())  # noqa: B023, E731
        w = np.zeros(5)
        w[-1] = np.log(prior / (1 - prior))
        m, v = np.zeros(5), np.zeros(5)
        for t in range(1, 11):
            below = parts(w)[1] < 0
            risk = lambda w: -parts(w)[1] if below else sum(parts(w))  # noqa: B023, E731
            g = np.array([(risk(w + e) - risk(w - e)) / 2e-6 for e in np.eye(5) * 1e-6])
            g[:-1] += 1e-4 * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        got, bias = toxicity._fit(x, positive, prior, 10, 0.05, 1e-4)
        assert np.allclose(np.append(got, bias), w, atol=0.02)  # a step of Adam is 0.05 whatever the size of the gradient


def test_language_scores_equal_plain_cosines(docs):
    """Prediction against loops over grams, weights and centroids."""
    model = language.train(docs)
    rows = docs.limit(25)
    got = {r["doc_id"]: r for r in language.predict(rows, model).collect()}
    for r in rows.collect():
        t = "".join(c if c.isalpha() else " " for c in r["text"].lower()) + "  "
        weight = {}
        for k, size in enumerate(language.SIZES):
            for i in range(len(t) + 1 - size):
                g = t[i : i + size]
                if g[:2] != "  " and not (size > 2 and g[1:] == "  "):
                    at = k * language.BUCKETS + int(vectors.gram_ids(np.array([ord(c) for c in g], np.uint32), size, language.BUCKETS)[0])
                    weight[at] = weight.get(at, 0) + 1
        weight = {a: np.log1p(n) * model.idf[a] for a, n in weight.items()}
        norm = sum(v * v for v in weight.values()) ** 0.5
        cosines = [sum(v * c[a] for a, v in weight.items()) / norm for c in model.centroids]
        best = int(np.argmax(cosines))
        assert got[r["doc_id"]]["lang_pred"] == model.labels[best] and abs(got[r["doc_id"]]["score"] - min(1, max(0, cosines[best]))) < 1e-9
        assert got[r["doc_id"]]["rejected"] == (cosines[best] < model.floor[model.labels[best]])


def test_quality_scores_equal_plain_softmax(docs, labels):
    model = quality_model.train(docs, labels)
    rows = docs.limit(20)
    got = {r["doc_id"]: r["score"] for r in quality_model.predict(rows, model, 0.3).collect()}
    for r in rows.collect():
        f = quality_model.features([r["text"]])[0]
        mean = [sum(f[i] * model.vectors[i, d] for i in np.flatnonzero(f)) for d in range(model.vectors.shape[1])]
        z = [sum(a * model.out[d, c] for d, a in enumerate(mean)) + model.bias[c] for c in range(2)]
        assert abs(got[r["doc_id"]] - np.exp(z[1]) / (np.exp(z[0]) + np.exp(z[1]))) < 1e-4


def test_gram_counts_and_words():
    texts = ["Abc abc", "", "  ", "ünd", "a1b"]
    m = vectors.gram_counts(texts, (2, 3), 64, letters_only=True)
    spelled = []
    for t in texts:
        t = "".join(c if c.isalpha() else " " for c in t.lower()) + "  "
        grams = [t[i : i + k] for k in (2, 3) for i in range(len(t) + 1 - k)]
        spelled.append(sum(not g.startswith("  ") and g[1:] != "  " for g in grams))
    assert m.sum(axis=1).tolist() == spelled and m.shape == (5, 128)
    assert (vectors.gram_counts(["xyz abc"], (2, 3), 64, True) == vectors.gram_counts(["q", "XYZ abc"], (2, 3), 64, True)[1]).all()
    cp, doc = vectors.code_points(["the cat the", "cat"], letters_only=False)
    ids, of = vectors.word_ids(cp, doc, 1 << 13)
    assert of.tolist() == [0, 0, 0, 1] and ids[0] == ids[2] and ids[1] == ids[3] and ids[0] != ids[1]


def test_slices_keep_all_rows():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"x": ["a" * 1000] * 700})
    assert [s.num_rows for s in slices([b], 256)] == [256, 256, 188] and sum(s.num_rows for s in slices([b], 256, 5000)) == 700


def test_pipeline_stages(spark):
    """Each stage against its operator's verdicts on its own input, the near duplicates against brute force."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "near_dedup", "decontamination", "packing"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and ids(out) <= ids(kept)
        if name == "language_id":
            assert ids(kept) - ids(out) == ids(language.predict(kept, language.train(kept)).where("rejected"))
        elif name == "quality_rules":
            assert ids(out) == ids(quality_rules.quality_rules(kept).where("kept"))
        elif name == "near_dedup":
            assert ids(out) == {c for _, c in brute([(r["doc_id"], r["text"]) for r in kept.collect()], 80).values()}
        else:
            items = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert ids(out) == {r["doc_id"] for r in kept.collect() if not any(i in decontaminate.plain(r["text"]) for i in items)}
        kept = out
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert ids(last) == ids(kept)
    run = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(run) == key(last)


def test_near_dedup_stage_drops_copies_of_similarity_080(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    at = {percent: {c for _, c in brute(texts, percent).values()} for percent in (80, 85)}
    assert at[80] < at[85]
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == at[80]


def test_one_of_repeated_rows_stays(spark):
    kept = corpus_pipeline.near_dedup(spark, odd_documents(spark), "/root/testdata/sf0.001")
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == [1, 4, 5, 6, 7, 9, 10, 12, 13, 14]


def test_a_row_goes_for_its_own_text_only(spark):
    first, own, other = (" ".join(f"{w}{i}" for i in range(60)) for w in ("first", "own", "other"))
    texts = [(1, first), (2, first + " end"), (2, own), (3, other), (3, other), (None, own), (None, other + " end"), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, first), (2, own), (3, other), (4, "")]


def test_pipeline_of_odd_documents(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    empty = no_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "/root/testdata/sf0.001")
    assert empty.count() == 0
    assert {r["doc_id"] for r in docs.collect()} <= {i for i, t in TEXTS if t and len(t.split()) >= 10}
