"""Column expressions that normalise labels, keys and numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spelling variants in the surveillance files and the label each one stands for.
COUNTY_VARIANTS = {
    "台中市(舊)": "台中市",
    "台南市(舊)": "台南市",
    "高雄縣(舊)": "高雄市",
    "臺北市": "台北市",
    "臺中市": "台中市",
    "臺南市": "台南市",
    "臺東縣": "台東縣",
    "桃園縣": "桃園市",
}
# Age groups of the files under one label.
AGE_VARIANTS = {"65-": "65+", "99": "unknown", "不詳": "unknown"}
# Visit kinds of the open-data files.
VISIT_KINDS = {"門診": "out", "住院": "inp", "急診": "er"}
# The two cities that form their own reporting region.
FOCUS_CITIES = ("台南市", "高雄市")


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def normalize_label(c: Column, variants: Mapping[str, str]) -> Column:
    """Trim, then replace a known variant; anything else passes through."""
    t = F.trim(c)
    return F.coalesce(F.try_element_at(literal_map(variants), t), t)


def compose_yw(week: Column, year: Column | None = None) -> Column:
    """A week text of five or more characters is already year+week; shorter ones get the year in front."""
    w = F.trim(week)
    if year is None:
        return w
    return F.when(F.length(w) >= 5, w).otherwise(F.concat(F.trim(year), F.lpad(w, 2, "0")))


def count_or_zero(c: Column) -> Column:
    """Whole number; text that is no number counts as 0. Decimal text is truncated."""
    return F.coalesce(c.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale*a/b, null where b is 0."""
    num = a if scale == 1.0 else F.lit(float(scale)) * a
    return num.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def is_week_key(c: Column) -> Column:
    """Six digits that name a week of the calendar: from 1 to the number of Wednesdays (52 or 53) in the year."""
    year, week = F.substring(c, 1, 4).cast("int"), F.substring(c, 5, 2).cast("int")
    jan1 = F.make_date(year, F.lit(1), F.lit(1))
    days = F.datediff(F.make_date(year, F.lit(12), F.lit(31)), jan1) - F.pmod(F.lit(4) - F.dayofweek(jan1), F.lit(7))
    inside = (year >= 1) & (week >= 1) & (week <= F.floor(days / 7) + 1)
    return F.when(c.rlike("^[0-9]{6}$"), inside).otherwise(F.lit(False))


def keep_groups(df: DataFrame, col: str, keep: DataFrame) -> DataFrame:
    """Rows whose group is in ``keep`` (one column)."""
    return df.join(keep.select(F.col(keep.columns[0]).alias(col)).distinct(), col, "left_semi")


def drop_groups(df: DataFrame, col: str, done: DataFrame) -> DataFrame:
    """Rows whose group is not in ``done`` (one column)."""
    return df.join(done.select(F.col(done.columns[0]).alias(col)).distinct(), col, "left_anti")


def series_part(series: Column, i: int, sep: str = "|") -> Column:
    """Piece ``i`` of a series name such as ``county|township``; null when there is no such piece."""
    return F.try_element_at(F.split(series, "[" + sep + "]"), F.lit(i + 1))


def region_of(
    series: Column, cities: Sequence[str] = FOCUS_CITIES, inside: str = "focus", outside: str = "other"
) -> Column:
    return F.when(series_part(series, 0).isin(*cities), inside).otherwise(outside)


def direction_class(v: Column, origin: Column, band: float = 0.05) -> Column:
    """1 up, -1 down, 0 within ±band of the origin value."""
    change = (v - origin) / F.greatest(F.abs(origin), F.lit(1e-9))
    return F.when(change > band, 1).when(change < -band, -1).otherwise(0)


# Default year segments of the summaries.
SEGMENTS = {"pre_covid": (2018, 2019), "covid": (2020, 2022), "post_covid": (2023, 2025)}


def segment_of(year: Column, segments: Mapping[str, tuple[int, int]] = SEGMENTS, other: str = "other") -> Column:
    c = None
    for name, (lo, hi) in segments.items():
        c = F.when(year.between(lo, hi), name) if c is None else c.when(year.between(lo, hi), name)
    return F.lit(other) if c is None else c.otherwise(other)


def event_type(threshold: Column, floor: float = 3.0, at_floor: str = "first_cluster", above: str = "accelerating") -> Column:
    return F.when(threshold <= floor, at_floor).otherwise(above)


def count_stratum(own: Column) -> Column:
    """Own recent cases in three strata: 0, 1, >=2 (cuts at .5 and 1.5)."""
    return F.when(own <= 0.5, "0").when(own <= 1.5, "1").when(own.isNotNull(), ">=2")


def trend_word(pct: Column, steep: float = 15.0) -> Column:
    """Five classes of percent change with cuts at ±5 and ±steep (15 for influenza, 25 elsewhere)."""
    return (
        F.when(pct >= steep, "fast_up").when(pct >= 5, "up").when(pct > -5, "flat").when(pct > -steep, "down")
        .when(pct.isNotNull(), "fast_down")
    )


def level_word(pct_rank: Column) -> Column:
    return (
        F.when(pct_rank >= 90, "high").when(pct_rank >= 75, "elevated").when(pct_rank >= 40, "medium")
        .when(pct_rank.isNotNull(), "low")
    )


def stage_word(level: Column, change_pct: Column, rising: Column, falling: Column) -> Column:
    """Two or more rises and >= +5 %, two or more falls and <= -5 %, else plateau at a raised level, else low."""
    return (
        F.when((rising >= 2) & (change_pct >= 5), "rising")
        .when((falling >= 2) & (change_pct <= -5), "falling")
        .when(level.isin("high", "elevated"), "plateau")
        .otherwise("low_activity")
    )


def pct5(p: Column) -> Column:
    """Probability to the nearest 5 % (ties to even)."""
    return (F.bround(p * 20) * 5).cast("int")


def round_or_null(x: Column, digits: int = 3) -> Column:
    """Rounded value, null for NaN, ready for JSON."""
    return F.round(F.nanvl(x.cast("double"), F.lit(None).cast("double")), digits)
