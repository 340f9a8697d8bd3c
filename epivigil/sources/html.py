"""Chart and map data embedded in fetched pages -> tables. One row per page in, long rows out; fetching is not done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHART = "struct<title_text:string,yAxis_title_text:string,xAxis_categories:array<string>,series:array<struct<name:string,data:array<string>>>>"


def chart_blocks(pages: DataFrame, html: str = "html", call: str = "hcJson") -> DataFrame:
    """One row per ``call.push({...});`` block with its parsed content (null when it is no JSON)."""
    rx = r"(?s)" + call + r"[.]push[(]([{].*?[}])[)];"
    raw = F.regexp_replace("_raw", r"\bundefined\b", "null")
    return (
        pages.withColumn("_raw", F.explode(F.regexp_extract_all(F.col(html), F.lit(rx), F.lit(1))))
        .withColumn("chart", F.from_json(raw, CHART))
        .drop("_raw")
        .where(F.col("chart.xAxis_categories").isNotNull())
    )


def point_value(text: Column) -> Column:
    """A data point is a number or an object with its value under y."""
    return F.coalesce(text.try_cast("double"), F.get_json_object(text, "$.y").try_cast("double"))


def chart_rows(blocks: DataFrame, keys: list[str], title: str | None = None) -> DataFrame:
    """(keys, metric title, period, series, value): category i with point i of each series; a series may be shorter."""
    b = blocks if title is None else blocks.where(F.contains(F.coalesce("chart.title_text", F.lit("")), F.lit(title)))
    return (
        b.select(*keys, F.col("chart.yAxis_title_text").alias("axis"), F.col("chart.xAxis_categories").alias("_x"), F.explode("chart.series").alias("_s"))
        .select(*keys, "axis", F.posexplode("_x").alias("_i", "period"), "_s")
        .select(*keys, "axis", "period", F.col("_s.name").alias("series"), point_value(F.try_element_at(F.col("_s.data"), F.col("_i") + 1)).alias("value"))
    )


def chart_table(rows: DataFrame, keys: list[str], rate_word: str = "比率") -> DataFrame:
    """The two charts of a page (rate and visits) side by side."""
    m = F.when(F.contains(F.col("axis"), F.lit(rate_word)), "rate_pct").otherwise("visits")
    return rows.withColumn("_m", m).groupBy(*keys, "period", "series").pivot("_m", ["rate_pct", "visits"]).agg(F.first("value", ignorenulls=True))


def map_rows(pages: DataFrame, keys: list[str], html: str = "html", var: str = "jdata1") -> DataFrame:
    """``var x = [{'code':...,'value':...}];`` -> (keys, region, rate_pct); pages without it give no rows."""
    raw = F.regexp_extract(html, r"(?s)var " + var + r" = (\[.*?\]);", 1)
    items = F.from_json(F.replace(raw, F.lit("'"), F.lit('"')), "array<struct<code:string,value:string>>")
    return (
        pages.where(F.contains(F.col(html), F.lit(f"var {var} = ")))
        .select(*keys, F.explode(items).alias("_e"))
        .select(*keys, F.col("_e.code").alias("region"), F.col("_e.value").try_cast("double").alias("rate_pct"))
    )
