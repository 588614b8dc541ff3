"""Readers and sinks for flat files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgrid.functions.numbers import parse_number
from termgrid.functions.text import strip
from termgrid.spec import PanelSpec, require_columns

# Column order of the timetable tables.
SECTION_FIELDS = (
    "term", "subject", "number", "course_id", "crn", "section_id", "section_number",
    "part_of_term", "start_date", "end_date", "credit_min", "credit_max", "credit_text",
)
MEETING_FIELDS = (
    "term", "subject", "number", "crn", "section_id", "meeting_index", "meeting_type",
    "days_raw", "weekdays", "start_time", "end_time", "building", "room", "start_date",
    "end_date", "is_arranged", "is_tba",
)


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV as all-text columns, matched by header name whatever the column order.

    The header of the file must hold every wanted column; extra ones are ignored.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return rows.select(*[F.col(f"`{c}`") for c in columns])


def read_grade_rows(spark: SparkSession, path: str, spec: PanelSpec | None = None) -> DataFrame:
    """The raw grade table, under the library's column names, still text."""
    spec = spec or PanelSpec()
    return spec.canonical(read_csv_text(spark, path, list(spec.columns.values())))


def _flag(name: str):
    return F.coalesce(F.lower(strip(F.col(name))).isin("true", "1", "yes"), F.lit(False)).alias(name)


def _text(name: str):
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv_text(spark, path, SECTION_FIELDS)
    credits = ("credit_min", "credit_max")
    return rows.select(
        *[parse_number(F.col(c)).alias(c) if c in credits else _text(c) for c in SECTION_FIELDS]
    )


def read_meetings(spark: SparkSession, path: str) -> DataFrame:
    """Meetings with weekdays as an array, flags as booleans, empty times as null."""
    rows = read_csv_text(spark, path, MEETING_FIELDS)
    typed = {
        "weekdays": F.filter(
            F.split(F.coalesce(F.col("weekdays"), F.lit("")), r"\|"), lambda d: d != ""
        ).alias("weekdays"),
        "meeting_index": F.coalesce(F.col("meeting_index").try_cast("int"), F.lit(0)).alias("meeting_index"),
        "start_time": F.when(F.col("start_time") != "", F.col("start_time")).alias("start_time"),
        "end_time": F.when(F.col("end_time") != "", F.col("end_time")).alias("end_time"),
        "is_arranged": _flag("is_arranged"),
        "is_tba": _flag("is_tba"),
    }
    return rows.select(*[typed.get(c, _text(c)) for c in MEETING_FIELDS])


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    """CSV sink with a fixed field order; arrays are written joined by ``|``."""
    fields = list(fields or df.columns)
    require_columns(df, fields)
    arrays = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    flat = df.select(*[
        F.array_join(F.col(f"`{c}`"), "|").alias(c) if c in arrays else F.col(f"`{c}`") for c in fields
    ])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON sink of a report frame, columns in name order."""
    df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).write.mode("overwrite").json(path)
