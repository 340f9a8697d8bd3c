"""Readers of the surveillance files. Everything is read as text and cast explicitly; no schema inference job runs.

Native CSV reading splits large files over tasks. Legacy Big5 text needs ``spark.sql.legacy.javaCharsets=true``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as lb

BIG5 = "MS950"
JAVA_CHARSETS = "spark.sql.legacy.javaCharsets"


def read_text_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, a byte-order mark stripped from the first name."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding=encoding)
    first = df.columns[0]
    clean = first.lstrip("﻿").strip('"')
    return df.withColumnRenamed(first, clean) if clean != first else df


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line of every file decodes as such, else Big5; a line that is neither is an error.

    Lines are read whole and by all executors; the first one found settles it.
    """
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("b"))
    if lines.where(F.col("b").isNotNull()).isEmpty():
        raise FileNotFoundError(f"no data in {path}")
    wrong = lines.where(~F.is_valid_utf8(F.col("b").cast("string")))
    if wrong.isEmpty():
        return "UTF-8"

    @F.pandas_udf("boolean")
    def is_big5(b: pd.Series) -> pd.Series:
        def ok(x: bytes) -> bool:
            try:
                bytes(x).decode("cp950")
            except UnicodeDecodeError:
                return False
            return True

        return b.map(ok)

    if not wrong.where(~is_big5("b")).isEmpty():
        raise ValueError(f"cannot decode {path}")
    return BIG5


def read_csv_auto(spark: SparkSession, path: str) -> DataFrame:
    """CSV in UTF-8 (with or without mark) or Big5, told apart by all of its lines."""
    enc = sniff_encoding(spark, path)
    if enc == BIG5 and spark.conf.get(JAVA_CHARSETS, "false") != "true":
        spark.conf.set(JAVA_CHARSETS, "true")
    return read_text_csv(spark, path, enc)


def find_column(columns: Sequence[str], test: Callable[[str], bool], what: str) -> str:
    for c in columns:
        if test(c):
            return c
    raise ValueError(f"no column for {what} among {list(columns)}")


def _name(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def _text(c: str) -> Column:
    return F.trim(_name(c))


def parse_visits(df: DataFrame) -> DataFrame:
    """Claims file by position: (year,) week, visit type, age, county, cases, total."""
    c = df.columns
    return df.select(
        _text(c[1]).alias("yw"), _text(c[2]).alias("visit_type"), lb.normalize_label(_name(c[3]), lb.AGE_VARIANTS).alias("age"),
        lb.normalize_label(_name(c[4]), lb.COUNTY_VARIANTS).alias("county"), lb.count_or_zero(_name(c[5])).alias("cases"),
        lb.count_or_zero(_name(c[6])).alias("total"),
    )


def read_visits(spark: SparkSession, path: str, encoding: str = BIG5) -> DataFrame:
    return parse_visits(read_text_csv(spark, path, encoding))


# Column names of the files by the name used here.
EMERGENCY_COLUMNS = {
    "yw": "年週", "age": "年齡別", "county": "就診醫院縣市別", "town": "就診醫院鄉鎮別", "hospital": "就診醫院",
    "ili": "類流感急診就診人次", "total": "急診就診總人次",
}
SEVERE_COLUMNS = {
    "yw": "發病週", "county": "縣市", "town": "鄉鎮", "sex": "性別", "imported": "是否為境外移入", "age": "年齡層", "cases": "確定病例數",
}
LAB_TYPE_COLUMNS = {
    "yw": "SR_YW", "county": "COUNTY_NAME", "town": "TOWN_NAME", "hospital": "HOSPITAL_NAME",
    "flu_a": "SUM_of_FLU_A", "flu_b": "SUM_of_FLU_B", "flu_u": "SUM_of_FLU_U",
}
LAB_TEST_COLUMNS = {"yw": "yearweek", "hospital": "HOSPITAL_NAME", "nhi_code": "NHI_CODE", "tests": "SUM_of_INSPECTION_NUM"}
LINE_LIST_COLUMNS = {
    "onset": "發病日", "report": "通報日", "confirm": "個案研判日", "county": "居住縣市", "township": "居住鄉鎮",
    "imported": "是否境外移入", "n": "確定病例數", "serotype": "血清型", "lon": "最小統計區中心點X", "lat": "最小統計區中心點Y",
    "village_code": "居住村里代碼",
}
YES = "是"
# Pathogen columns of the laboratory file.
PATHOGENS = {
    "Influenza": "resp_flu", "RSV": "resp_rsv", "SARS-CoV-2": "resp_covid", "hMPV": "resp_hmpv", "Parainfluenza": "resp_para",
    "Rhinovirus": "resp_rhino", "Adeno": "resp_adeno", "Mycoplasma": "resp_myco",
}

_COUNTS = {"ili", "total", "cases", "flu_a", "flu_b", "flu_u", "tests"}


def by_name(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns picked by name: counts whole numbers with garbage as 0, counties and ages normalised, yes/no boolean."""
    out = []
    for name, src in names.items():
        c = _name(src)
        if name in _COUNTS:
            c = lb.count_or_zero(c)
        elif name == "county":
            c = lb.normalize_label(c, lb.COUNTY_VARIANTS)
        elif name == "age":
            c = lb.normalize_label(c, lb.AGE_VARIANTS)
        elif name == "imported":
            c = F.coalesce(c == YES, F.lit(False))
        elif name == "yw":
            c = F.trim(c)
        out.append(c.alias(name))
    return df.select(*out)


def read_emergency(spark: SparkSession, path: str, encoding: str = BIG5) -> DataFrame:
    return by_name(read_text_csv(spark, path, encoding), EMERGENCY_COLUMNS)


def read_severe_cases(spark: SparkSession, path: str, encoding: str = BIG5) -> DataFrame:
    return by_name(read_text_csv(spark, path, encoding), SEVERE_COLUMNS)


def read_lab_types(spark: SparkSession, path: str, encoding: str = BIG5) -> DataFrame:
    return by_name(read_text_csv(spark, path, encoding), LAB_TYPE_COLUMNS)


def read_lab_tests(spark: SparkSession, path: str, encoding: str = BIG5) -> DataFrame:
    return by_name(read_text_csv(spark, path, encoding), LAB_TEST_COLUMNS)


def read_resp_lab(spark: SparkSession, path: str) -> DataFrame:
    """Weekly pathogen counts: future weeks without any count left out; totals, share, estimated tests, 3-week means.

    One row per week, so the trailing mean may order the file's weeks in one partition.
    """
    return parse_resp_lab(read_text_csv(spark, path))


def parse_resp_lab(df: DataFrame) -> DataFrame:
    wk = find_column(df.columns, lambda c: c.lower().startswith("year-week"), "week")
    paths = list(PATHOGENS.values())
    d = df.select(
        _text(wk).alias("yw"), *[_name(s).try_cast("double").alias(t) for s, t in PATHOGENS.items()],
        _name("Positive (%)").try_cast("double").alias("resp_pos_pct"),
    ).where(F.coalesce(*paths).isNotNull())
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in paths[1:]), F.coalesce(F.col(paths[0]), F.lit(0.0)))
    d = d.withColumn("resp_total_pos", total)
    d = d.withColumn("resp_flu_share", lb.ratio(F.col("resp_flu"), F.col("resp_total_pos")))
    d = d.withColumn("resp_tests_est", lb.ratio(F.col("resp_total_pos"), F.col("resp_pos_pct") / 100))
    d = d.withColumn("resp_flu_pos_rate", lb.ratio(F.col("resp_flu"), F.col("resp_tests_est"), 100))
    w = W.orderBy("yw").rowsBetween(-2, 0)
    return d.withColumns({"resp_flu_ma3": F.avg("resp_flu").over(w), "resp_flu_pos_rate_ma3": F.avg("resp_flu_pos_rate").over(w)})


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system Spark itself would use."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    d = read_text_csv(spark, path)
    return d.select(
        F.try_to_date(F.col("date")).alias("date"), "name", (F.lower(F.col("isHoliday")) == "true").alias("isHoliday"), "holidayCategory",
        "description",
    )


CLOSURE_SCHEMA = "date date, name string, scope string, n_counties int, source string, status string"


def read_closures(spark: SparkSession, path: str) -> DataFrame:
    """The closure list; an absent file is an empty table of the same schema."""
    if not exists(spark, path):
        return spark.createDataFrame([], CLOSURE_SCHEMA)
    d = read_text_csv(spark, path)
    return d.select(
        F.try_to_date(F.col("date")).alias("date"), "name", "scope", F.col("n_counties").try_cast("int").alias("n_counties"), "source", "status"
    )


def _week_column(df: DataFrame) -> Column:
    if "年週" in df.columns:
        return _text("年週")
    return lb.compose_yw(_name("週"), _name("年"))


def parse_open_visits(df: DataFrame, disease: str) -> DataFrame:
    """Open-data claims: case and total columns found by header, visit kind mapped; an unknown kind raises."""
    cases = find_column(df.columns, lambda c: disease.upper() in c.upper() and "人次" in c and "總" not in c, "cases")
    total = find_column(df.columns, lambda c: "總人次" in c, "total")
    kind = F.try_element_at(lb.literal_map(lb.VISIT_KINDS), _text("就診類別"))
    bad = F.raise_error(F.concat(F.lit("unknown visit kind: "), F.coalesce(_name("就診類別"), F.lit("null")))).cast("string")
    return df.select(
        _week_column(df).alias("yw"), F.coalesce(kind, bad).alias("kind"), _text("年齡別").alias("age"),
        lb.normalize_label(_name("縣市"), lb.COUNTY_VARIANTS).alias("county"), lb.count_or_zero(_name(cases)).alias("cases"),
        lb.count_or_zero(_name(total)).alias("total"),
    )


def parse_open_emergency(df: DataFrame, disease: str) -> DataFrame:
    cases = find_column(df.columns, lambda c: disease.upper() in c.upper() and "人次" in c, "cases")
    return df.select(
        _week_column(df).alias("yw"), _text("年齡別").alias("age"), lb.normalize_label(_name("縣市"), lb.COUNTY_VARIANTS).alias("county"),
        lb.count_or_zero(_name(cases)).alias("cases"),
    )


def read_open_visits(spark: SparkSession, path: str, disease: str) -> DataFrame:
    return parse_open_visits(read_csv_auto(spark, path), disease)


def read_open_emergency(spark: SparkSession, path: str, disease: str) -> DataFrame:
    return parse_open_emergency(read_csv_auto(spark, path), disease)


REGION_VISITS_SCHEMA = "yw string, area string, age string, case_type string, visits double, rate_pct double"


def read_region_visits(spark: SparkSession, path: str, area: str = "全國", age: str = "全部", case_type: str = "oe") -> DataFrame:
    """Visits by region; weeks after the last one with visits in the national series are placeholders and go."""
    from ..operators.panel import trim_placeholder_tail

    if not exists(spark, path):
        return spark.createDataFrame([], REGION_VISITS_SCHEMA)
    d = read_text_csv(spark, path)
    d = d.select("yw", "area", "age", "case_type", F.col("visits").try_cast("double").alias("visits"), F.col("rate_pct").try_cast("double").alias("rate_pct"))
    filled = (F.col("area") == area) & (F.col("age") == age) & (F.col("case_type") == case_type) & (F.col("visits") > 0)
    return trim_placeholder_tail(d, filled)


def read_severe_weekly(spark: SparkSession, path: str) -> DataFrame:
    """(yw, severe); no file, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "yw string, severe double")
    return read_text_csv(spark, path).select("yw", F.col("severe").try_cast("double").alias("severe"))


def parse_line_list(df: DataFrame, names: Mapping[str, str] = LINE_LIST_COLUMNS, date_format: str = "yyyy/M/d", dmax: int = 120) -> DataFrame:
    """Daily case list with delay in days within [0, dmax]; bad dates null, no onset no row, no report = onset, no count = 1.

    Coordinates and village code, where the file has them, come from the same scan.
    """
    from ..operators.linelist import delay_days

    day = lambda k: F.try_to_date(_name(names[k]), date_format)
    cols = [
        day("onset").alias("onset"), day("report").alias("report"), day("confirm").alias("confirm"),
        F.replace(_name(names["county"]), F.lit("臺"), F.lit("台")).alias("county"), _name(names["township"]).alias("township"),
        F.coalesce(_name(names["imported"]) == YES, F.lit(False)).alias("imported"),
        F.coalesce(_name(names["n"]).try_cast("double").cast("int"), F.lit(1)).alias("n"), _name(names["serotype"]).alias("serotype"),
    ]
    if all(k in names and names[k] in df.columns for k in ("lon", "lat", "village_code")):
        cols += [_name(names["lon"]).try_cast("double").alias("lon"), _name(names["lat"]).try_cast("double").alias("lat"),
                 _name(names["village_code"]).alias("village_code")]
    d = df.select(*cols).where(F.col("onset").isNotNull())
    d = d.withColumn("report", F.coalesce("report", "onset"))
    return d.withColumn("delay", delay_days(F.col("onset"), F.col("report"), dmax))


def read_line_list(spark: SparkSession, path: str, **kw) -> DataFrame:
    return parse_line_list(read_text_csv(spark, path), **kw)


# File names of the raw sources.
RAW_FILES = {
    "nhi_48x": "NHI_PROCESSED_48X.csv", "nhi_48x_er": "NHI_PROCESSED_48X_ER.csv", "nhi_487": "NHI_PROCESSED_487.csv",
    "nhi_487_er": "NHI_PROCESSED_487_ER.csv", "rods": "RODS_RS.csv", "nidds": "NIDDS_487A.csv",
    "lab_types": "INFLUENZA_TYPE_YW.csv", "lab_tests": "INFLUENZA_MON_TYPE_YW.csv", "resp_lab": "RESP_LAB.csv",
}


def load_all(spark: SparkSession, folder: str, files: Mapping[str, str] = RAW_FILES, optional: Sequence[str] = ("resp_lab",),
             readers: Mapping[str, Callable] | None = None) -> dict[str, DataFrame]:
    """Name -> lazy table of every raw source; an absent optional file is left out."""
    known: dict[str, Callable] = {
        "rods": read_emergency, "nidds": read_severe_cases, "lab_types": read_lab_types, "lab_tests": read_lab_tests, "resp_lab": read_resp_lab,
    }
    known.update(readers or {})
    out = {}
    for name, f in files.items():
        path = f"{folder.rstrip('/')}/{f}"
        if name in optional and not exists(spark, path):
            continue
        out[name] = known.get(name, read_visits)(spark, path)
    return out


def read_panel(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored panel; named columns keep the scan narrow."""
    d = spark.read.parquet(path)
    return d.select(*columns) if columns else d


_RESULT = r"(final|asof|asof_adj|asof_ncr?\d+(?:[.]\d+)?(?:x2)?)_forecasts[.]parquet$"


def result_files(names: Sequence[str], tag: str) -> list[tuple[str, str]]:
    """(mode, name) of the stored results of exactly this tag, sorted; longer tags with the same start do not match."""
    rx = re.compile("^" + re.escape(tag) + "_" + _RESULT)
    return [(m.group(1), n) for n in sorted(names) if (m := rx.match(n))]


def list_names(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_results(spark: SparkSession, folder: str, tag: str, keys: Sequence[str] = ("model", "mode", "series", "origin", "h")) -> DataFrame:
    """All modes of a tag as one table without duplicate keys."""
    from ..operators.snapshots import merge_runs

    files = result_files(list_names(spark, folder), tag)
    if not files:
        raise FileNotFoundError(f"no results of {tag} in {folder}")
    return merge_runs([spark.read.parquet(f"{folder}/{n}") for _, n in files], keys)
