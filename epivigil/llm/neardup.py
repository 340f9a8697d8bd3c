"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges, links confirmed on full sets.

Documents with equal shingle sets form a class, and only a class's first document goes on. A signature has ``BANDS * ROWS`` bins:
the smallest shingle hash of each range of hashes, and empty bins borrow from bins that a hash of bin and attempt points to (optimal
densification). The smallest member of a bucket is its centre. A member is compared on full sets with the smallest of its centres,
and with the others only while they are in another component. With 42 bands of 6 bins two sets of similarity 0.80 share no bucket
with a probability of 3e-6, two of 0.85 with 3e-9.

Stars alone lose links between members that are not near their centre. A member's difference from the centre, D (shingles that one
of the two has alone), tells all pairs apart: x and y differ in |Dx| + |Dy| - 2 |Dx and Dy|, so two members that are near each other
but not both near the centre must share so many elements of D that they share one among the first few of both, in any common order.
Members of different components are therefore joined on these first elements, those of the fewest members in front: edits of the
centre itself, which all members share, come last, and are met only by members that share enough of them to be linked. The smallest
member that has an element is compared with the others before any two of these are, so that a crowd is joined by stars and not
paired off. What the joins find is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import slices
from .components import components

BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
ATTEMPTS = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = _mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_PROBE = (_mix(np.arange(ATTEMPTS * BINS, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int16).reshape(ATTEMPTS, BINS)


class Shingler:
    """Distinct hashed ``width``-word shingles of texts: A-Z in lower case, words between ASCII white space.

    A text of fewer words has one shingle of all its words; one without words has none.
    """

    def __init__(self, width: int = 5):
        self.width = width

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """A sorted array of 64-bit hashes for each text; None is an empty text.

        The texts are copied first: ``ascii_lower`` mistakes the offsets of a slice.
        """
        import xxhash

        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts.to_pylist()], pa.large_string())))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        values = list(map(xxhash.xxh3_64_intdigest, words))
        codes = coded.indices.to_numpy()
        blank = np.array([w == "" for w in words], bool)
        keep = ~blank[codes] if len(blank) else np.zeros(0, bool)
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[keep]
        h = np.array(values, np.uint64)[codes[keep]] if len(values) else np.zeros(0, np.uint64)
        n = np.bincount(doc, minlength=len(texts))
        k = self.width
        rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            rolled += h[j : j + len(rolled)] * _ODD[j]
        rolled = _mix(rolled)
        out, at = [], 0
        for m in n.tolist():
            if m >= k:
                out.append(np.unique(rolled[at : at + m - k + 1]))
            elif m:
                out.append(_mix(np.array([(h[at : at + m] * _ODD[8 : 8 + m]).sum(dtype=np.uint64) + np.uint64(m)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += m
        return out


def signature(s: np.ndarray) -> np.ndarray:
    """The bins of a sorted set of hashes; the set must not be empty."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    sig, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sig[bins[first]] = s[first]
    full[bins[first]] = True
    own = sig.copy()
    empty = np.flatnonzero(~full)
    for a in range(24):
        if not len(empty):
            return sig
        at = _PROBE[a, empty]
        hit = full[at]
        sig[empty[hit]] = own[at[hit]]
        empty = empty[~hit]
    if len(empty):  # a set of few shingles
        hits = full[_PROBE[:, empty]]
        at = np.where(hits.any(axis=0), _PROBE[hits.argmax(axis=0), empty], bins[first[0]])
        sig[empty] = own[at]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    return _mix((rows * _ODD[16 : 16 + ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[40])


def _signatures(docs: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in slices(batches, 2048):
            sets = shingler.sets(b.column(1))
            keys = [band_keys(signature(s)).view(np.int64) if len(s) else None for s in sets]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_shingles": np.array([len(s) for s in sets], np.int64), "digest": pa.array(digests, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))})

    return docs.mapInArrow(of, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, members): the sorted shingle hashes of the documents whose id is in ``nodes``."""
    # the ids grow with the documents: never a broadcast, however few they are in a small table
    texts = docs.join(nodes.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left_semi").select("doc_id", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        for b in slices(batches, 512):
            data = [s.tobytes() for s in shingler.sets(b.column(1))]
            marks = [(i, hashlib.blake2b(x, digest_size=16).digest()) for i, x in zip(b.column(0).to_pylist(), data)]
            fresh = [m not in seen and not seen.add(m) for m in marks]  # a repeated row goes on once
            yield pa.RecordBatch.from_pydict({"node": b.column(0), "members": pa.array(data, pa.binary())}).filter(pa.array(fresh, pa.bool_()))

    return texts.mapInArrow(of, "node long, members binary")


def most_apart(n: int, m: int, percent: int) -> int:
    """How many shingles two linked sets of n and m shingles may differ in."""
    return (100 - percent) * (n + m) // (100 + percent)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """``pairs`` (node, centre) with ``linked``; or with the node's set size n and ``apart``, the shingles that one of the two has alone."""
    left = pairs.join(sets, "node").select("node", "centre", "members")
    right = sets.select(F.col("node").alias("centre"), F.col("members").alias("others"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512, 32 << 20):
            out = {"n": [], "apart": []} if differences else {"linked": []}
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                mine = t[np.minimum(np.searchsorted(t, s), len(t) - 1)] != s
                theirs = s[np.minimum(np.searchsorted(s, t), len(s) - 1)] != t
                if differences:
                    out["n"].append(len(s))
                    out["apart"].append(np.concatenate([s[mine], t[theirs]]).view(np.int64))
                else:
                    out["linked"].append(int(mine.sum() + theirs.sum()) <= most_apart(len(s), len(t), percent))
            if differences:
                out["apart"] = pa.array(out["apart"], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"node": b.column(0), "centre": b.column(1)} | out)

    found = "n long, apart array<long>" if differences else "linked boolean"
    return left.join(right, "centre").select("node", "centre", "members", "others").mapInArrow(compare, f"node long, centre long, {found}")


def _mixed(stars: DataFrame, comps: DataFrame) -> DataFrame:
    """centre, its component, and the smallest and largest pivot and component of its members, for centres that see two components."""
    members = stars.join(comps, "node", "left").select("pivot", F.coalesce("comp", "node").alias("comp"), F.explode("centres").alias("centre"))
    ends = members.groupBy("centre").agg(*[f(c).alias(f"{n}_{c}") for c in ("pivot", "comp") for n, f in (("low", F.min), ("high", F.max))])
    own = ends.join(comps.select(F.col("node").alias("centre"), "comp"), "centre", "left").withColumn("comp", F.coalesce("comp", "centre"))
    return own.where("low_comp < high_comp or low_comp <> comp").withColumnRenamed("comp", "centre_comp")


def _of_mixed(stars: DataFrame, mixed: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """(node, centre, pivot) of the stars whose centre is in ``mixed``; with ``comps`` only of nodes in another component than the centre."""
    rows = stars if comps is None else stars.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    at = rows.withColumn("centre", F.explode("centres")).drop("centres")
    if comps is None:
        return at.join(mixed.select("centre"), "centre").select("node", "centre", "pivot")
    other = mixed.select(F.col("centre").alias("_centre"), "centre_comp")
    return at.join(other, (F.col("centre") == F.col("_centre")) & (F.col("comp") != F.col("centre_comp"))).select("node", "centre", "pivot")


def _rare_first(apart: DataFrame, percent: int) -> DataFrame:
    """centre, element, node, n, size, at: for each member the first elements of its difference that a near member must share, the rarest in front.

    Elements that no other member of the centre has are left out; their places count.
    """
    rows = apart.select("centre", "node", "n", F.size("apart").cast("long").alias("size"), F.explode("apart").alias("element"))
    often = written(rows.groupBy("centre", "element").count().where("count > 1"), "shared-elements")
    rows = rows.join(often, ["centre", "element"], "left").withColumn("count", F.coalesce("count", F.lit(1)))
    # a difference is no longer than two sets
    ordered = rows.groupBy("centre", "node", "n", "size").agg(F.sort_array(F.collect_list(F.struct("count", "element"))).alias("e"))
    # a partner that is near has at most 100 / percent times the node's size
    front = (F.floor((100 - percent) * (F.col("n") + F.floor(100 * F.col("n") / percent)) / F.lit(100 + percent)) + 1).cast("int")
    at = ordered.withColumn("e", F.slice("e", F.lit(1), front)).select("centre", "node", "n", "size", F.posexplode("e").alias("at", "e"))
    return at.where("e.count > 1").select("centre", F.col("e.element").alias("element"), "node", "n", "size", "at")


def _may_be_near(percent: int):
    """Whether two members that share an element, the second in columns with ``_``, may be linked by it and are not yet."""
    may = F.floor((100 - percent) * (F.col("n") + F.col("_n")) / F.lit(100 + percent))
    shared = F.ceil((F.col("size") + F.col("_size") - may) / 2)  # elements of both differences that a link needs
    near = (F.col("_node") < F.col("node")) & (F.col("comp") != F.col("_comp")) & (F.abs(F.col("size") - F.col("_size")) <= may)
    return near & (F.col("at") <= F.col("size") - shared) & (F.col("_at") <= F.col("_size") - shared)


def _labelled(elements: DataFrame, comps: DataFrame) -> DataFrame:
    return elements.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _mixed_elements(rows: DataFrame) -> DataFrame:
    """centre, element and the smallest member (columns with ``_``), where the members are of several components."""
    hub = F.min(F.struct("node", "n", "size", "at", "comp")).alias("hub")
    ends = rows.groupBy("centre", "element").agg(hub, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return ends.select("centre", "element", *[F.col(f"hub.{c}").alias(f"_{c}") for c in ("node", "n", "size", "at", "comp")])


def _beside_the_centre(elements: DataFrame, comps: DataFrame, percent: int, stars: bool) -> DataFrame:
    """(node, centre): pairs of members of one centre, in different components, that share an element and may be linked.

    With ``stars`` only the pairs with the smallest member that has the element.
    """
    rows = _labelled(elements, comps)
    hubs = written(_mixed_elements(rows), "mixed-elements")
    if not stars:
        rows = written(rows.join(hubs.select("centre", "element"), ["centre", "element"], "left_semi"), "members-of-mixed")
        hubs = rows.select("centre", "element", *[F.col(c).alias(f"_{c}") for c in ("node", "n", "size", "at", "comp")])
    met = rows.join(hubs, ["centre", "element"]).where(_may_be_near(percent))
    return met.select("node", F.col("_node").alias("centre")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text; other columns are ignored).

    Links join documents with 100 * intersection >= ``percent`` * union of their shingle sets; a component has the smallest doc_id
    that it reaches, and only that document is kept. A document without words has no shingles and is linked with nothing. A row
    without doc_id belongs to the component of its text and is kept only if no row of that text has an id. Rows that share
    an id are compared under that id, whatever their texts. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = written(_signatures(docs), "signatures")
    classes = written(sig.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "classes")
    members = classes.where("node is not null").select(F.explode("bands").alias("key"), "node")
    buckets = written(members.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("_last")).where("centre < _last").select("key", "centre"), "buckets")
    # one row a member: its centres (one for each band at most) are unfolded only where they differ
    met = members.join(buckets, "key").where("node <> centre").groupBy("node")
    stars = written(met.agg(F.min("centre").alias("pivot"), F.collect_set("centre").alias("centres")), "stars")
    sets = written(_sets(docs, stars.select("node").union(buckets.select("centre")).distinct()), "shingle-sets")
    ends = lambda df: df.where("linked").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    # each member meets its smallest centre, then those of its other centres that are in another component
    first = written(_compared(stars.select("node", F.col("pivot").alias("centre")), sets, percent), "compared")
    found = components(ends(first))
    apart = _of_mixed(stars, _mixed(stars, found), found).where("centre <> pivot").select("node", "centre")
    second = written(_compared(apart, sets, percent), "compared")
    links = ends(first).unionByName(ends(second))
    found = components(links)
    # members of one smallest centre, and those of a bucket that have several of them
    labels = stars.join(found, "node", "left").select("pivot", F.coalesce("comp", "node").alias("comp"))
    pivots = labels.groupBy("pivot").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    of_pivots = stars.join(pivots.select("pivot"), "pivot", "left_semi").select("node", F.col("pivot").alias("centre"))
    mixed = written(_mixed(stars, found).where("low_pivot < high_pivot and low_comp < high_comp"), "mixed-centres")
    beside = of_pivots.union(_of_mixed(stars, mixed).select("node", "centre")).distinct()
    elements = written(_rare_first(written(_compared(beside, sets, percent, differences=True), "differences"), percent), "first-elements")
    # first with the smallest member that has an element, which joins a crowd by stars; then what is still apart
    for star in (True, False):
        others = written(_beside_the_centre(elements, found, percent, star), "pairs")
        if others.limit(1).count():
            links = links.unionByName(ends(written(_compared(others, sets, percent), "compared")))
            found = components(links)
    of_class = written(classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("comp", "node").alias("component_id")), "class-components")
    out = sig.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
