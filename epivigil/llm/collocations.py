"""Phrases whose words belong together, by best-first branch and bound over a tree of prefixes.

A node is a phrase that occurs often enough, a child adds one word. No phrase occurs more often than its prefix q, and its first word
w is known, so every phrase below q scores at most ``floor(2000000 * f(q) / (f(w) + f(q)))``: an admissible bound. In each round the
nodes that are best by bound or score in their language are opened: one pass over the texts counts their one-word extensions, which
gives the children's counts and scores, and shows whether a longer phrase covers the node itself. ``T``, the score of the last place
among the surviving phrases found so far, then prunes: a node is opened only while its bound, or its own unsettled score, is at least
T (equal scores included). When no such node is left, no phrase outside can reach the result.

A pass sees which nodes are open through Bloom filters of a fixed size, whatever the number of nodes. They let a phrase through by
its words alone, so all its occurrences are counted or none: wrong hits cost counting but change no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import slices

LONGEST = 4  # words of a phrase
SCORE = 2_000_000
BLOOM_BITS = 26  # a filter has 2^26 bits (8 MiB)
PARTS = 32  # parts of a language that are sorted by themselves before its best nodes meet

_CLASS = np.zeros(256, np.uint8)  # 0: in words, 1: between words, 2: between pieces
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = _mix(np.arange(1, 16, dtype=np.uint64)) | np.uint64(1)


def word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))


def phrase_hashes(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their language and words, place by place."""
    h = lang * _ODD[0] + np.uint64(len(words))
    for k, w in enumerate(words):
        h = _mix(h ^ (w * _ODD[k + 1]))
    return h


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    low = np.uint64(64 - bits)
    return h >> low, (h * _ODD[14]) >> low, (h * _ODD[13]) >> low


class Bloom:
    """A set of hashes that may also seem to hold others."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = (len(words) * 64).bit_length() - 1

    def hit(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in _bits(h, self.bits):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def bloom(phrases: DataFrame, bits: int = BLOOM_BITS) -> Bloom:
    """The filter of ``phrases`` (lang, phrase). Tasks send the words of the filter that they set; at most 2^bits / 64 reach the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lang, lists = b.column(0).dictionary_encode(), pc.split_pattern(b.column(1), " ")
            flat = pc.list_flatten(lists).dictionary_encode()
            h, sizes = word_hashes(flat.dictionary)[flat.indices.to_numpy()], pc.list_value_length(lists).to_numpy()
            start = np.cumsum(sizes) - sizes
            of_lang = word_hashes(lang.dictionary)[lang.indices.to_numpy()]
            whole = np.zeros(len(sizes), np.uint64)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                whole[at] = phrase_hashes(of_lang[at], [h[start[at] + k] for k in range(n)])
            at = np.unique(np.concatenate(_bits(whole, bits)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.RecordBatch.from_pydict({"word": word.astype(np.int64), "value": value.view(np.int64)})

    found = phrases.select("lang", "phrase").mapInArrow(of, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return Bloom(words)


class Tokens:
    """The words of a batch of texts: ``code`` into ``words``, hash, language, and the piece that each stands in."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = texts.cast(pa.large_string()) if texts.null_count == 0 else pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(offsets[-1] - offsets[0])
        data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
        ends = offsets[1:] - offsets[0]
        kind = _CLASS[data]
        solid = kind == 0
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        at = (ends - np.diff(offsets))[np.diff(offsets) > 0]
        begins[at] = solid[at]
        start = np.flatnonzero(begins)
        length = np.add.reduceat(solid, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
        bounds = np.zeros(len(start) + 1, np.int64)
        np.cumsum(length, out=bounds[1:])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[solid]])).dictionary_encode()
        self.words, self.code = words.dictionary, words.indices.to_numpy().astype(np.int64)
        doc = np.searchsorted(ends, start, side="right")
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), start) + doc
        lang = langs.dictionary_encode()
        self.langs, self.lang = lang.dictionary, lang.indices.to_numpy().astype(np.int64)[doc]
        self.hash = word_hashes(self.words)[self.code] if len(start) else np.zeros(0, np.uint64)
        self.lang_hash = word_hashes(self.langs)[self.lang] if len(start) else np.zeros(0, np.uint64)

    def starts(self, n: int) -> np.ndarray:
        """Where n words of one piece follow each other."""
        m = len(self.code) - n + 1
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[:m]) if m > 0 else np.zeros(0, np.int64)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return phrase_hashes(self.lang_hash[at], [self.hash[at + k] for k in range(n)])

    def counts(self, at: np.ndarray, n: int) -> pa.RecordBatch:
        """lang, phrase and count of the phrases of n words that begin at ``at``."""
        key = self.lang[at] * len(self.words) + self.code[at]
        for k in range(1, n):  # dense numbers for the phrases of k words keep the next key within 64 bits
            key = np.unique(key, return_inverse=True)[1] * len(self.words) + self.code[at + k]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        phrase = self.words.take(pa.array(self.code[first]))
        for k in range(1, n):
            phrase = pc.binary_join_element_wise(phrase, self.words.take(pa.array(self.code[first + k])), pa.scalar(" ", pa.large_string()))
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[first])).cast(pa.string()), phrase.cast(pa.string()), pa.array(count, pa.int64())], ["lang", "phrase", "f"])


def _count(docs: DataFrame, wanted) -> DataFrame:
    """(lang, phrase, words, f): counts of the phrases at the places that ``wanted`` gives for a batch, as (number of words, places)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20, 8 << 20):
            tokens = Tokens(b.column(1), b.column(0))
            for n, at in wanted(tokens):
                if len(at):
                    yield tokens.counts(at, n)

    sums = docs.mapInArrow(of, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return sums.select("lang", "phrase", (F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1).cast("long").alias("words"), "f")


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)); the product may pass 64 bits."""
    return F.call_function("div", F.lit(SCORE).cast("decimal(18,0)") * a.cast("decimal(19,0)"), (l.cast("decimal(19,0)") + r.cast("decimal(19,0)")).cast("decimal(20,0)")).cast("long")


def _best(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each language with their ``place``; parts of a language are cut first, so none is sorted in one task."""
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = parts.withColumn("_n", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_n") <= most)
    return few.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("place") <= most).drop("_part", "_n")


def _scored(new: DataFrame, known: DataFrame) -> DataFrame:
    """``new`` with l, r and score of the lowest-scoring cut, and bound.

    The score is null while the count of a part is unknown; then the phrase's prefix was not opened, so its score is below T.
    """
    cuts = new.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', int(k))"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    at = lambda c, f: known.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    cuts = cuts.join(at("first", "l"), ["lang", "first"], "left").join(at("rest", "r"), ["lang", "rest"], "left")
    f = F.col("f")
    cuts = cuts.withColumn("at", _score(f, F.col("l"), F.col("r"))).withColumn("top", F.when(F.col("k") == 1, _score(f, F.col("l"), f)))
    lowest = F.when(F.count("at") == F.count(F.lit(1)), F.min(F.struct("at", "k", "l", "r")))
    out = cuts.groupBy("lang", "phrase", "words", "f").agg(lowest.alias("cut"), F.max("top").alias("bound"))
    return out.select("lang", "phrase", "words", "f", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.at").alias("score"), "bound")


def _prefix() -> Column:
    return F.expr("substring_index(phrase, ' ', int(words - 1))")


def _suffix() -> Column:
    return F.expr("substring(phrase, locate(' ', phrase) + 1)")


def phrases(docs: DataFrame, top: int = 2000, least: int = 30, covered: int = 80, first_batch: int = 8000, bits: int = BLOOM_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best ``top`` phrases of two to four words of each language of ``docs`` (lang, text).

    A-Z become lower case; words are what stands between spaces and tabs, and no phrase crosses ``. , ; : ! ?`` or a line end. Phrases
    that occur ``least`` times or more are scored by their lowest-scoring cut, unless a longer one that holds them has ``covered``
    percent of their count. Order: score, count, then the phrase's bytes. A null lang is ``und``; null and empty texts have no words;
    repeated rows count each time; an empty table gives no rows. Other columns are not read. ``first_batch`` nodes of a language are
    opened in the first round and eight times as many in each further one; it changes the work, not the result.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = written(_count(docs, lambda t: [(1, t.starts(1))]), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= least)

    def filter_of(df: DataFrame) -> Bloom:
        return bloom(df, min(bits, max(10, (16 * df.count()).bit_length())))

    # the root: every word has the same bound, so all are opened
    frequent = filter_of(often)

    def pairs(t: Tokens):
        hit, at = frequent.hit(t.hashes(t.starts(1), 1)), t.starts(2)
        return [(2, at[hit[at] & hit[at + 1]])]

    counts = written(_count(docs, pairs).where(F.col("f") >= least), "phrases")
    known = often.unionByName(counts)
    nodes = written(_scored(counts, known), "nodes")
    frequent2 = filter_of(counts)
    survivors, opened, cutoff, batch = nodes.limit(0), None, None, first_batch
    while True:
        waiting = nodes.where(F.col("words") < LONGEST)
        if opened is not None:
            waiting = waiting.join(opened.select("lang", "phrase"), ["lang", "phrase"], "left_anti").join(cutoff, "lang", "left")
            waiting = waiting.where(F.col("bound") >= F.coalesce("least_score", F.lit(0))).drop("least_score")
        now = written(_best(waiting, [F.desc("bound"), F.asc("words"), F.asc("phrase")], batch).drop("place"), "opened")
        if now.isEmpty():
            break
        settled = now
        if cutoff is not None:
            settled = now.join(cutoff, "lang", "left").where(F.col("score") >= F.coalesce("least_score", F.lit(0))).drop("least_score")
        of_length = lambda df, k: df.where(F.col("words") == k).select("lang", "phrase")
        # the parts that the cuts of new four-word phrases need are counted along with them
        beside = now.where(F.col("words") == 3).select("lang", _suffix().alias("phrase"))
        open2 = filter_of(of_length(now, 2).unionByName(beside).distinct())
        open3, settle2, settle3 = (filter_of(of_length(df, k)) for df, k in ((now, 3), (settled, 2), (settled, 3)))

        def longer(t: Tokens, open2=open2, open3=open3, settle2=settle2, settle3=settle3):
            out = []
            for k, prefixes, suffixes in ((2, open2, settle2), (3, open3, settle3)):
                at, whole = t.starts(k), np.zeros((3, len(t.code) + 1), bool)
                h = t.hashes(at, k)
                whole[0, at], whole[1, at] = prefixes.hit(h), suffixes.hit(h)
                whole[2, at] = frequent2.hit(h) if k == 2 else True
                at = t.starts(k + 1)
                out.append((k + 1, at[(whole[0, at] & whole[2, at + 1]) | (whole[1, at + 1] & whole[2, at])]))
            return out

        found = written(_count(docs, longer).where(F.col("f") >= least), "phrases")
        cover = found.select("lang", _prefix().alias("phrase"), "f").unionByName(found.select("lang", _suffix().alias("phrase"), "f"))
        cover = cover.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        big = lambda c, by: F.lit(by).cast("decimal(9,0)") * F.col(c).cast("decimal(19,0)")
        free = settled.join(cover, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (big("longer", 100) < big("f", covered))).drop("longer")
        new = found.join(known.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
        known = known.unionByName(new)
        rescored = nodes.where(F.col("score").isNull()).select("lang", "phrase", "words", "f")
        scored = written(_scored(new.unionByName(rescored), known), "nodes")
        nodes = nodes.where(F.col("score").isNotNull()).unionByName(scored)
        survivors = survivors.unionByName(free).unionByName(scored.where((F.col("words") == LONGEST) & F.col("score").isNotNull()))
        survivors = written(_best(survivors, [F.desc("score"), F.desc("f"), F.asc("phrase")], top), "survivors")
        cutoff = survivors.where(F.col("place") == top).select("lang", F.col("score").alias("least_score"))
        survivors = survivors.drop("place")
        opened = now if opened is None else opened.unionByName(now)
        batch *= 8
    out = _best(survivors, [F.desc("score"), F.desc("f"), F.asc("phrase")], top).join(totals, "lang")
    return out.select("lang", F.col("place").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
