"""One query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from . import collocations, decontaminate, exact_dedup, html_text, language, neardup, packing, quality_model, quality_rules, token_counts, token_files, toxicity, vector_codes
from .common import held_out, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_digests(spark, path)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packing.pack(cut, ["doc_id", "piece"], capacity=1024)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs.select("doc_id", "text"), language.train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), error_rate=0.05)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.predict(docs, quality_model.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"), top=2000, least=30, covered=80)


_W = r"[^\x20\x09-\x0D]+"
_STOP = ", ".join(f"'{s}'" for s in quality_rules.STOP_WORDS)
OP1_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS y FROM t),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(y) AS BIGINT) AS n_lines,
  CAST(len(y) - len(list_distinct(y)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), [{_STOP}])) AS n_stop_words,
  CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars / n_words < 2 OR word_chars / n_words > 20 OR n_symbols / n_words > 0.25 OR (n_words >= 40 AND n_stop_words < 1)
    OR n_dup_lines / n_lines > 0.5 OR n_upper / word_chars > 0.5) AS kept
FROM b
"""

QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_token_binary, op3_best_fit_packing, op4_minhash_near_dedup, op5_html_extraction, op6_language_id, op7_toxicity, op8_benchmark_decontamination,
    op9_quality_classifier, op10_token_counts, op11_exact_dedup, op12_vector_codes, op13_phrase_collocations,
)}
OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents),
g AS (SELECT text, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256 FROM t JOIN g ON t.text = g.text
"""

_DIMS = "abcd"  # the vectors of the tables have 64 components, so parts of four
_NEAR = " + ".join(f"(x.{d} - b.{d}) * (x.{d} - b.{d})" for d in _DIMS)


def _round(i: int) -> str:
    """Codebooks ``b<i>`` from assignments to ``b<i - 1>``."""
    floor = ", ".join(f"CAST((sum({d}) - ((sum({d}) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS {d}" for d in _DIMS)
    mean = ", ".join(f"coalesce(m.{d}, b.{d}) AS {d}" for d in _DIMS)
    return f"""a{i} AS (SELECT vec_id, p, min(({_NEAR}) * 64 + e) AS m FROM x JOIN b{i - 1} AS b USING (p) GROUP BY vec_id, p),
m{i} AS (SELECT p, m % 64 AS e, {floor} FROM x JOIN a{i} USING (vec_id, p) GROUP BY p, m % 64),
b{i} AS (SELECT b.p, b.e, {mean} FROM b{i - 1} AS b LEFT JOIN m{i} AS m USING (p, e))"""


OP12_SQL = f"""
WITH v AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
x AS (SELECT vec_id, r, p, {", ".join(f"CAST(floor(256 * CAST(embedding[4 * p + {k + 1}] AS DOUBLE)) AS BIGINT) AS {d}" for k, d in enumerate(_DIMS))} FROM v CROSS JOIN (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, r - 1 AS e, a, b, c, d FROM x WHERE r <= 64),
{_round(1)},
{_round(2)},
f AS (SELECT vec_id, p, min(({_NEAR}) * 64 + e) AS m FROM x JOIN b2 AS b USING (p) GROUP BY vec_id, p),
c AS (SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM f GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM c JOIN v USING (vec_id)
"""

OP13_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c JOIN g AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN g AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, k, a, unnest(range(2, k)) AS m FROM c), (SELECT unnest([1, 2, 3]) AS i) WHERE i + m - 1 <= k GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM lowest JOIN n USING (lang) LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000
"""

SQL = {"op13_phrase_collocations": OP13_SQL, "op12_vector_codes": OP12_SQL, "op1_quality_rules": OP1_SQL, "op11_exact_dedup": OP11_SQL}
