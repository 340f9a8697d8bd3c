"""Exact duplicates by deterministic naming of blocks, in DataFrame operations only.

A normalised text is cut into blocks of ``BLOCK`` bytes. The blocks of all documents are sorted, and equal ones get one integer
name. Then adjacent names of a document are paired, equal pairs get one name, and so on until each document has a single name.
Documents of as many blocks have trees of one shape, so their last names are equal only if all their bytes are: the identity
(number of blocks, last name) has no collisions, and no fingerprint decides anything.

A name is the number of the first row of a run of equal keys. A key that very many rows hold (copies of one text) is sorted in parts
dealt by row number, and the first rows of the parts are then named together, so a group of any size is never one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

BLOCK = 2048  # bytes
PARTS = 64  # parts of a key that many rows hold
#: A run of white space that is not a single space already.
GAP = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    """The text with each run of white space as one space; a null text is an empty one."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), GAP, " ")


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """Each block (at least one a document) with its number ``uid``, place, and on the first one the document's id and digest."""

    # a generator, so that the text is normalised once and not for each use
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.explode(F.array(normalised().cast("binary"))).alias("bytes"))
    last = F.floor(F.greatest(F.length("bytes") - 1, F.lit(0)) / F.lit(block)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("bytes"), i * block + 1, F.lit(block)))
    cells = rows.select("doc_id", "row", F.sha2("bytes", 256).alias("text_sha256"), (last + 1).cast("long").alias("n"), F.posexplode(blocks).alias("at", "block"))
    first = F.col("at") == 0
    of_doc = [F.when(first, F.col(c)).alias(c) for c in ("doc_id", "text_sha256")]
    return cells.select(F.monotonically_increasing_id().alias("uid"), "row", F.col("at").cast("long").alias("at"), "n", *of_doc, "block")


def name_keys(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``rows`` without ``keys`` and with ``name``, one integer for equal keys: the smallest ``uid`` among them. Stored as ``out``.

    Nulls are equal to each other. ``uid`` must be distinct and the same whenever the rows are read again. Keys whose hash more rows
    hold than an eighth of a mean partition (so of eight times the partitions at most) are sorted in parts.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = rows.withColumn("_hash", F.xxhash64(*keys))
    counts = written(hashed.groupBy("_hash").count(), f"{out}-counts")  # two numbers for each key
    total = counts.agg(F.sum("count")).first()[0] or 0
    crowded = counts.where(F.col("count") > max(PARTS, total // (8 * partitions))).select("_hash", F.lit(True).alias("_many"))
    kept = [c for c in rows.columns if c not in keys]
    if crowded.isEmpty():
        return written(rows.select(*kept, F.min("uid").over(W.partitionBy(*keys)).alias("name")), out)
    dealt = hashed.join(F.broadcast(crowded), "_hash", "left")
    dealt = dealt.withColumn("_part", F.when(F.col("_many"), F.pmod(F.xxhash64("uid"), F.lit(PARTS))).otherwise(F.lit(0)))
    local = dealt.withColumn("_local", F.min("uid").over(W.partitionBy(*keys, "_part")))
    head = F.col("_many") & (F.col("uid") == F.col("_local"))
    local = written(local.select(*kept, "_local", head.alias("_head"), *[F.when(head, F.col(k)).alias(k) for k in keys]), f"{out}-parts")
    heads = local.where("_head").select("_local", *keys)
    names = heads.select("_local", F.min("_local").over(W.partitionBy(*keys)).alias("_name"))
    return written(local.drop(*keys, "_head").join(names, "_local", "left").withColumn("name", F.coalesce("_name", "_local")).drop("_local", "_name"), out)


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text) of every row of ``docs`` (doc_id, text).

    Texts are equal when they are identical after each run of ASCII white space becomes one space; a null text is an empty one, and
    empty texts are equal to each other. Of equal texts the row with the smallest doc_id stays; a row without doc_id stays only if no
    equal row has one, and of rows that repeat the id one stays. Other columns are not read; an empty table gives no rows.
    """
    level = name_keys(_blocks(docs, block), ["block"], "block-names")
    documents = level.where("at = 0").select("row", "doc_id", "text_sha256", "n")
    level = level.select("uid", "row", "at", "n", F.col("n").alias("left"), "name")
    done = [level.where("left = 1")]
    longest = level.agg(F.max("left")).first()[0] or 1
    while longest > 1:
        side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("name")))
        pairs = level.where("left > 1").groupBy("row", F.floor(F.col("at") / 2).alias("at"))
        pairs = pairs.agg(F.min("uid").alias("uid"), F.first("n").alias("n"), F.ceil(F.first("left") / 2).alias("left"), side(0).alias("first"), side(1).alias("second"))
        level = name_keys(written(pairs, "pairs"), ["first", "second"], "pair-names")
        done.append(level.where("left = 1"))
        longest = (longest + 1) // 2
    identity = done[0].select("row", "n", "name")
    for d in done[1:]:
        identity = identity.unionByName(d.select("row", "n", "name"))
    rows = written(documents.join(identity, ["row", "n"]), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = written(rows.groupBy("n", "name").agg(F.min(order).alias("stays"), F.count("*").alias("group_size")), "equal-texts")
    out = rows.join(groups, ["n", "name"])
    return out.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256")
