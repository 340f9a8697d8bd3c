"""Best-fit packing of documents into sequences of a fixed capacity, in bulk-synchronous rounds.

Documents longer than the capacity are cut so that only the first piece may be shorter than a sequence. Full pieces are sequences
of their own. The other pieces are ranked by length (a range sort), and open sequences by their gap. In a round every gap is
matched with its successor among the pieces: from the longest length down, pieces of one length take the smallest gaps that hold
them, and one gap takes as many of them as it can. Which of equally long pieces goes to which of equally wide gaps is a matter of
their ranks, so no two pieces meet. Gaps are updated and sorted again, and rounds go on until no piece fits any gap; then new
sequences are opened with the longest pieces left. A gap that takes its fill of one length keeps less than that length, so less
than half of itself: the rounds are about log2(capacity) for each opening.

Lengths are at most the capacity, so what rounds exchange with the driver are counts for each length, never rows. Pieces and
sequences stay in Spark tables, written to the shared folder in each round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written
from .common import slices
from .encoding import encoder

ROWS_OF_TASK = 100_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32.

    ``end_id`` follows each document's ids; a null text is empty and has it alone. Repeated rows have pieces of their own. Only
    documents of more than ``capacity`` tokens are cut, and only a first piece is shorter. ``with_ids`` adds the ids themselves.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, end_id)
        for b in slices(batches, 2048):
            ids, n = code.encode(b.column(1).to_pylist())
            ids = ids.astype("<u4")
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            head = n - (many - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            at = np.repeat(np.cumsum(n) - n, many) + start
            data = memoryview(ids.tobytes())
            out = {
                "doc_id": b.column(0).take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length,
                "ids_crc32": np.array([zlib.crc32(data[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist())], np.int64),
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_pydict(out)

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, fields)


def _tasks(rows: int) -> int:
    return max(1, -(-rows // ROWS_OF_TASK))


def _ranked(df: DataFrame, size: str, tie: list[str], rows: int, name: str) -> tuple[DataFrame, dict[int, int]]:
    """``df`` written in order of ``size``, with the rank of each row among those of its size, and the count of each size.

    A size with most of the rows is spread over tasks, as ``tie`` takes part in the order; each task numbers its own rows, and
    the counts of the tasks before it are added.
    """
    ordered = df.repartitionByRange(_tasks(rows), size, *tie).sortWithinPartitions(size, *tie)
    kept = written(ordered.withColumns({"_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)
    runs = kept.groupBy(size, "_task").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # ordered by size, a task has few sizes: at most as many runs as there are tasks and sizes together
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(size).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = {r[0]: r[1] for r in runs.groupBy(size).agg(F.sum("_n")).collect()}
    ranked = kept.join(F.broadcast(runs.select(size, "_task", "_first", "_before")), [size, "_task"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_row") - F.col("_first")).drop("_task", "_row", "_first", "_before"), counts


def sweep(left: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """One round by counts: (gap, first rank of the gaps, gaps, length, pieces) from the longest length down; each gap takes one length."""
    found, used = [], dict.fromkeys(gaps, 0)
    open_ = sorted(g for g, n in gaps.items() if n)
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        need = left[length]
        while need:
            gap = next((g for g in open_ if g >= length), None)
            if gap is None:
                break
            each, free = gap // length, gaps[gap] - used[gap]
            take = min(free, -(-need // each))
            put = min(need, take * each)
            found.append((gap, used[gap], take, length, put))
            used[gap] += take
            need -= put
            if used[gap] == gaps[gap]:
                open_.remove(gap)
    return found


def pack(items: DataFrame, key: list[str], length: str = "length", capacity: int = 1024) -> DataFrame:
    """``items`` with sequence_id and offset: every row in one sequence, no sequence longer than ``capacity``, offsets without gaps.

    ``key`` columns tell rows apart and settle which of equally long rows comes first; rows equal in them are kept, each in a place
    of its own. Lengths below 1 or null are an error, as is one above ``capacity``. Columns named like those added are replaced.
    An empty table stays empty.
    """
    spark = items.sparkSession
    names = [c for c in items.columns if c not in ("sequence_id", "offset", "rank")]
    rows = written(items.select(*names), "pieces")
    n_rows, low, high, missing = rows.agg(F.count(F.lit(1)), F.min(length), F.max(length), F.count(F.when(F.col(length).isNull(), 1))).first()
    if n_rows == 0:
        return rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    if missing or low < 1 or high > capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    ranked, count = _ranked(rows, length, key, n_rows, "ranked-pieces")
    full = count.pop(capacity, 0)
    n_sequences, done = full, {x: 0 for x in count}
    placed: list[DataFrame] = []  # one written table for each round: sequence, length, first rank, pieces, offset
    gaps: DataFrame | None = None
    n_gaps = 0

    def plan(rows_: list[tuple], fields: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows_, fields))  # at most two rows for each length and gap: bounded by the capacity

    def open_new() -> tuple[DataFrame, int]:
        """Sequences with the longest pieces left: as many as their tokens need, and one for each longer than half a sequence."""
        tokens = sum(x * (n - done[x]) for x, n in count.items())
        want = max(1, -(-tokens // capacity), sum(n - done[x] for x, n in count.items() if 2 * x > capacity))
        steps, base = [], 0
        for x in sorted(count, reverse=True):
            take = min(count[x] - done[x], want - base)
            if take > 0:
                steps.append((base, x, done[x]))
                done[x] += take
                base += take
        starts, lengths, firsts = (np.array(c, np.int64) for c in zip(*steps))
        number = n_sequences

        def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i = b.column(0).to_numpy()
                k = np.searchsorted(starts, i, "right") - 1
                yield pa.RecordBatch.from_pydict({"sequence_id": number + i, "_length": lengths[k], "_rank": firsts[k] + i - starts[k], "_pieces": np.ones_like(i), "offset": np.zeros_like(i)})

        return spark.range(0, base, 1, _tasks(base)).mapInArrow(seed, "sequence_id long, _length long, _rank long, _pieces long, offset long"), base

    while any(done[x] < n for x, n in count.items()):
        left = {x: n - done[x] for x, n in count.items()}
        found: list = []
        if gaps is not None:
            shortest = min(x for x, n in left.items() if n)
            gaps = gaps.where(F.col("gap") >= shortest)  # a narrower gap takes nothing any more
            ordered, by_gap = _ranked(gaps, "gap", ["sequence_id"], n_gaps, "gaps")
            n_gaps = sum(by_gap.values())
            found = sweep(left, by_gap)
        if not found:
            new, base = open_new()
            new = written(new, "opened")
            placed.append(new)
            n_sequences += base
            opened = new.select("sequence_id", (F.lit(capacity) - F.col("_length")).alias("gap")).where("gap > 0")
            gaps = opened if gaps is None or not n_gaps else ordered.select("sequence_id", "gap").unionByName(opened)
            n_gaps += base
            continue
        steps = []
        for gap, first, take, x, put in found:
            steps.append((gap, first, first + take, x, done[x], put))
            done[x] += put
        at = plan(steps, "_gap long, _from long, _to long, _length long, _first long, _put long")
        each = F.floor(F.col("gap") / F.col("_length")).cast("long")
        nth = F.col("rank") - F.col("_from")
        met = ordered.join(at, (F.col("gap") == F.col("_gap")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")), "left").select(
            "sequence_id", "gap", "_length", (F.col("_first") + nth * each).alias("_rank"), F.least(each, F.col("_put") - nth * each).alias("_pieces"), (F.lit(capacity) - F.col("gap")).alias("offset"))
        met = written(met, "met")
        placed.append(met.where("_length is not null").drop("gap"))
        gaps = met.select("sequence_id", (F.col("gap") - F.coalesce(F.col("_length") * F.col("_pieces"), F.lit(0))).alias("gap"))

    whole = ranked.where(F.col(length) == capacity).select(*names, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not placed:
        return whole
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    one = every.select("sequence_id", F.col("_length").alias(length), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)).alias("_j"), "_rank", "offset")
    one = one.select("sequence_id", length, (F.col("_rank") + F.col("_j")).alias("rank"), (F.col("offset") + F.col("_j") * F.col(length)).alias("offset"))
    short = ranked.where(F.col(length) < capacity).join(one, [length, "rank"]).select(*names, "sequence_id", "offset")
    return whole.unionByName(short)


def packed_ids(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """The sequences themselves: sequence_id and its ids in order. A sequence has at most ``capacity`` ids, so a group is small."""
    p = pack(pieces(docs, tokenizer, end_id, capacity, with_ids=True), ["doc_id", "piece"], capacity=capacity)
    return p.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p")).select("sequence_id", F.flatten(F.transform("_p", lambda x: x["ids"])).alias("ids"))
