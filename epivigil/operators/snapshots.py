"""Snapshots and stored results: differences, upserts, histories, slimming windows, merged runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str], filled: str | None = None) -> DataFrame:
    """(key, kind, changes): 'added' keys, and 'revised' ones with a map column -> 'old->new'.

    ``filled``: column that must be non-null in the new row for an added key; a key whose old value there was null
    counts as added.
    """
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_old"))
    n = new.select(key, *cols)
    j = n.join(o, key, "left")
    absent = F.col("_old").isNull()
    has = F.lit(True)
    if filled:
        absent = absent | (F.col(f"_o_{filled}").isNull() & F.col(filled).isNotNull())
        has = F.col(filled).isNotNull()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    changes = F.map_from_entries(
        F.filter(
            F.array(*[
                F.struct(F.lit(c).alias("k"), F.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.concat(text(f"_o_{c}"), F.lit("->"), text(c))).alias("v"))
                for c in cols
            ]),
            lambda e: e["v"].isNotNull(),
        )
    )
    changed = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in cols])
    d = j.withColumn("kind", F.when(absent, F.when(has, "added")).when(changed, "revised"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return d.where(F.col("kind").isNotNull()).select(key, "kind", F.when(F.col("kind") == "revised", changes).otherwise(none).alias("changes"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows win; old rows with other keys stay."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_dates(history: DataFrame, new: DataFrame, date_col: str = "fetched_on") -> DataFrame:
    """Rows of the dates in ``new`` are replaced, all others kept."""
    return upsert(history, new, [date_col])


def slim_latest(snapshot: DataFrame, end: Column, excluded_days: int = 90) -> DataFrame:
    """Confirmed or pending rows of any date, others only of the last ``excluded_days`` days."""
    return snapshot.where((F.col("confirmed") > 0) | (F.col("pending") > 0) | (F.col("date").cast("date") >= F.date_sub(end, excluded_days)))


def history_window(snapshot: DataFrame, end: Column, days: int = 180) -> DataFrame:
    return snapshot.where(((F.col("confirmed") > 0) | (F.col("pending") > 0)) & (F.col("date").cast("date") >= F.date_sub(end, days)))


def last_weeks(df: DataFrame, n: int, yw: str = "yw") -> DataFrame:
    """Rows of the n latest distinct weeks (a list of weeks is short)."""
    weeks = df.select(yw).distinct().orderBy(F.desc(yw)).limit(n)
    return df.join(weeks, yw, "left_semi")


def merge_runs(runs: Sequence[DataFrame], keys: Sequence[str], keep: str = "first") -> DataFrame:
    """Union of result tables without duplicate keys; the first (or last) table holding a key wins."""
    allf = None
    for i, r in enumerate(runs):
        t = r.withColumn("_run", F.lit(i))
        allf = t if allf is None else allf.unionByName(t, allowMissingColumns=True)
    order = F.asc("_run") if keep == "first" else F.desc("_run")
    w = W.partitionBy(*keys).orderBy(order)
    return allf.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_run")
