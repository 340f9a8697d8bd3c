"""Token counts by a sentencepiece model: huge documents in overlapping chunks that are spliced at proven borders.

A border between two characters is proven when no piece of the vocabulary goes over it: the second character is a space and no
piece has a space behind another character, or one of the two is a character that no piece has at all. Pieces are merged only into
pieces of the vocabulary, so what stands on one side of such a border never changes the other side. Two neighbouring chunks are
spliced at the last proven border of their overlap at which both have a token end and whose tokens around it agree; if there is
none, the overlap is doubled and the left chunk encoded again, up to the document's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "\u2581"


class Counter:
    """Counts tokens; texts of more than ``chunk`` characters go in chunks of that size that overlap by ``overlap`` characters."""

    def __init__(self, path: str, chunk: int = 16384, overlap: int = 512):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, max(1, min(overlap, chunk // 2))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.in_pieces = frozenset("".join(pieces))
        self.space_breaks = all(SPACE not in p.lstrip(SPACE) for p in pieces)
        sample = " a  b\n\tc "  # a model that rewrites white space has other offsets: its texts are never cut
        self.keeps_text = self.model.normalize(sample).lstrip(SPACE).replace(SPACE, " ") == sample.lstrip(" ") and not any(len(self.model.normalize(c)) > 2 for c in "ﬁ½Å")

    def proven(self, text: str, at: int) -> bool:
        """No piece can hold both the character before ``at`` and the one there."""
        a, b = text[at - 1], text[at]
        if b == SPACE or a == SPACE:
            return False
        return b == " " and a != " " and self.space_breaks or a != " " and a not in self.in_pieces or b != " " and b not in self.in_pieces

    def _ends(self, text: str) -> np.ndarray:
        """The character at which each token ends; bytes of one character share its end."""
        bytes_to = np.fromiter((p.end for p in self.model.encode(text, return_type="proto").pieces), np.int64)
        starts = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80  # offsets are in bytes
        return np.concatenate([[0], np.cumsum(starts)])[bytes_to]

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.keeps_text:
            return len(self.model.encode(text))
        total, start, skip = 0, 0, 0  # skip: tokens of the chunk at ``start`` that the chunk before it has counted
        overlap, size = self.overlap, self.chunk
        ends = self._ends(text[:size])
        while start + size < len(text):
            nxt = start + size - overlap
            right = self._ends(text[nxt : nxt + self.chunk])
            cut = self._splice(text, start, ends, nxt, right, start + size)
            if cut is None:
                overlap *= 2
                size += overlap
                ends = self._ends(text[start : start + size])
                continue
            left, met = cut
            total += left - skip
            start, ends, skip, overlap, size = nxt, right, met, self.overlap, self.chunk
        return total + len(ends) - skip

    def _splice(self, text, start, ends, nxt, right, stop):
        """Tokens of the left chunk up to the border, and of the right chunk; None if no border holds."""
        common = np.intersect1d(ends + start, right + nxt)
        for at in common[(common > nxt + 1) & (common < min(stop, len(text)))][::-1].tolist():
            if self.proven(text, at):
                left, met = int(np.searchsorted(ends, at - start, "right")), int(np.searchsorted(right, at - nxt, "right"))
                if left < len(ends) and met < len(right) and ends[left] + start == right[met] + nxt:
                    return left, met
        return None


_KEPT: dict[tuple, Counter] = {}


def token_counts(docs: DataFrame, model: str, chunk: int = 16384, overlap: int = 512, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted one by one; an empty table gives no rows.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = (model, chunk, overlap)
        if k not in _KEPT:
            _KEPT[k] = Counter(*k)
        c = _KEPT[k]
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            small = [i for i, t in enumerate(texts) if len(t) <= chunk or not c.keeps_text]
            n = np.zeros(len(texts), np.int64)
            n[small] = [len(x) for x in c.model.encode([texts[i] for i in small], num_threads=1)] if small else []
            for i in set(range(len(texts))).difference(small):
                n[i] = c.count(texts[i])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64), "n_tokens": n})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
