"""Benchmark decontamination: pigeonhole pieces of test items, and Myers' bit-parallel distance around each exact hit.

A test item of n characters may be met with up to ``error_rate * n`` edits. Cut into one piece more than that many edits, at least
one piece of every such match is unharmed, so an exact search for the pieces finds the place of every match. Texts and items are
compared in lower case with runs of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import slices


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """An item for Myers' algorithm; Python integers are its bit vectors, so items of any length are one word."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.full, self.top = (1 << self.n) - 1, 1 << (self.n - 1)
        self.bits: dict[str, int] = {}
        for i, c in enumerate(text):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def best_end(self, window: str) -> tuple[int, int]:
        """The smallest distance of the item to any part of ``window``, and the first place where such a part ends."""
        plus, minus, score, full, top, bits = self.full, 0, self.n, self.full, self.top, self.bits
        best, end = self.n, 0
        for i, c in enumerate(window):
            eq = bits.get(c, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(horizontal | plus) & full, plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, end = score, i + 1
            up, down = up << 1, down << 1
            plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        return best, end


class Matcher:
    """Finds items (id, text) in texts with at most ``error_rate`` edits for each character of the item."""

    def __init__(self, items: list[tuple], error_rate: float):
        import ahocorasick

        self.items, self.pieces = [], ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            text = plain(text)
            if not text:
                continue
            k = min(int(error_rate * len(text)), len(text) - 1)
            place = len(self.items)
            self.items.append((key, Pattern(text), Pattern(text[::-1]), k))
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                at.setdefault(text[a:b], []).append((place, a))
        for piece, uses in at.items():
            self.pieces.add_word(piece, (len(piece), uses))
        if at:
            self.pieces.make_automaton()

    def matches(self, text: str | None) -> list[tuple]:
        """(id, distance, start, end) of the best match of each item in the plain form of ``text``; the first of equal ones."""
        text = plain(text)
        if not text or not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.pieces.iter(text):
            for place, offset in uses:
                _, p, _, k = self.items[place]
                start = last + 1 - size - offset
                a, b = max(0, start - k), min(len(text), start + p.n + k)
                have = windows.setdefault(place, [])
                if have and have[-1][0] <= a <= have[-1][1]:
                    have[-1][1] = max(b, have[-1][1])
                else:
                    have.append([a, b])
        out = []
        for place, spans in windows.items():
            key, p, back, k = self.items[place]
            best = None
            for a, b in _merged(spans):
                exact = text.find(p.text, a, b)
                d, end = (0, exact + p.n - a) if exact >= 0 else p.best_end(text[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a, a + end)
                    if d == 0:
                        break
            if best:
                d, a, end = best
                start = end - back.best_end(text[max(0, end - p.n - k) : end][::-1])[1] if d else end - p.n
                out.append((key, d, start, end))
        return out


BLOCK_CHARS = 4 << 20


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def item_blocks(items: DataFrame, key: str, text: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_chars`` characters, one block in the driver's memory at a time."""
    some = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = some.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for i in range(n):
        yield [(r["k"], r["t"]) for r in some.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i).collect()]


def _marked(blocks: Iterator[list[tuple]]) -> Iterator[tuple[list[tuple], bool, bool]]:
    """Each block with whether it is the first and the last one; two blocks are in memory at a time."""
    block, first = next(blocks), True
    while block is not None:
        after = next(blocks, None)
        yield block, first, after is None
        block, first = after, False


_KEPT: dict[tuple, Matcher] = {}


def _matcher(items: list[tuple], error_rate: float) -> Matcher:
    k = (len(items), hash(tuple(items)), error_rate)
    if k not in _KEPT:
        _KEPT.clear()
        _KEPT[k] = Matcher(items, error_rate)
    return _KEPT[k]


def find_items(docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", error_rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start and end (in the plain text) of the best match of each item in each row of ``docs``.

    Every item is held against every row, block of items by block. Null and empty texts and items match nothing. An item of fewer
    than ``1 / error_rate`` characters is met only exactly. Of several blocks each one's matches are stored before the next is read. Repeated rows and repeated items have matches of their own; other
    columns are not read.
    """
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = None
    for block, first, last in _marked(item_blocks(items, key, text, block_chars)):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            m = _matcher(block, error_rate)
            for b in slices(batches):
                found = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in m.matches(t)]
                names = ("doc_id", "item_id", "distance", "start", "end")
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(5)], names=names)

        hits = mine.mapInArrow(search, "doc_id long, item_id long, distance long, start long, end long")
        hits = hits if first and last else written(hits, "item-hits")
        out = hits if out is None else out.unionByName(hits)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", error_rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with all columns, without the rows in which an item is met. A null text is kept."""
    for block, _, last in _marked(item_blocks(items, key, text, block_chars)):
        place = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch], block=block, place=place) -> Iterator[pa.RecordBatch]:
            m = _matcher(block, error_rate)
            for b in slices(batches):
                yield b.filter(pa.array([not m.matches(t) for t in b.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
        docs = docs if last else written(docs, "clean-so-far")
    return docs
