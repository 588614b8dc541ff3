"""Panel and timetable views over the star-schema test tables.

They give the grade rows (course x term x instructor) and the meetings the same
shapes the real sources have, by projection and equi-joins only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termgrid.functions.text import section_id
from termgrid.spec import BANDS, PanelSpec, TrajectorySpec

PANEL = PanelSpec(window=(1996, 1997, 1998), first_year=1995, last_year=2001)
TRAJECTORY = TrajectorySpec(
    source_years=(1995, 1996, 1997, 1998, 1999, 2000), train_years=(1998, 1999),
    holdout_year=2000, primary_years=(1997, 1998, 1999),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: a course (part) offered in a term (order date)."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"),
        F.year("o_orderdate").alias("_year"),
        F.month("o_orderdate").alias("_month"),
    )
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    part, quantity, dated = F.col("p_partkey"), F.col("l_quantity"), F.col("_year")
    # Spring-only, fall-only and gap courses: rows move to another term or year, none is left out.
    spring = F.when(part % 5 == 0, True).when(part % 7 == 0, False).otherwise(F.col("_month") <= 6)
    gap = (part % 3 == 1) & (dated % 2 == 1)
    year = F.when(gap & (dated < 2000), dated + 1).when(gap, dated - 1).otherwise(dated)
    returned = F.col("l_returnflag") == "R"
    band = F.floor((quantity - 1) * 13 / 50)
    title = (
        F.when(F.col("p_name").like("%gizmo") | (F.col("l_linenumber") == 7),
               F.concat(F.lit("Special Topics: "), F.col("p_name")))
        .when(F.col("l_linestatus") == "O", F.concat(F.upper(F.col("p_name")), F.lit("!")))
        .when(F.col("l_discount") >= 0.1, F.concat(F.col("p_name"), F.lit(" II")))
        .otherwise(F.col("p_name"))
    )
    return rows.select(
        year.alias("year"),
        F.when(spring, "Spring").otherwise("Fall").alias("term"),
        F.concat(year.cast("string"), F.when(spring, "-sp").otherwise("-fa")).alias("year_term"),
        F.col("p_brand").alias("subject"),
        part.cast("string").alias("number"),
        title.alias("title"),
        F.col("l_linestatus").alias("sched_type"),
        *[F.when(~returned & (band == i), quantity).otherwise(0.0).alias(b) for i, b in enumerate(BANDS)],
        F.when(returned, quantity).otherwise(0.0).alias("w"),
        F.when(~returned, F.nullif(quantity, F.lit(13.0))).otherwise(0.0).alias("students"),
        F.col("l_suppkey").cast("string").alias("instructor"),
    )


def _clock(minute):
    return F.concat(
        F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((minute % 60).cast("string"), 2, "0"),
    )


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One meeting per event: a week is the term, a user the section."""
    events = table(spark, sf_dir, "events")
    start = F.hour("ts") * 60 + F.minute("ts")
    end = start + 20 + F.col("event_id") % 60
    days = F.array(*[F.lit(d) for d in ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")])
    day = F.day("ts") % 7 + 1
    two_days = F.array(F.get(days, day - 1), F.get(days, day % 7))
    rows = events.select(
        F.concat(F.lit("w"), F.weekofyear("ts").cast("string")).alias("term"),
        F.lit("U").alias("subject"),
        (F.col("user_id") % 7).cast("string").alias("number"),
        F.col("user_id").cast("string").alias("crn"),
        F.col("event_id").cast("int").alias("meeting_index"),
        F.col("event_type").alias("meeting_type"),
        F.lit("").alias("days_raw"),
        F.when(F.col("event_id") % 4 == 0, two_days).otherwise(F.array(F.get(days, day - 1))).alias("weekdays"),
        _clock(start).alias("start_time"),
        F.when(end < 24 * 60, _clock(end)).alias("end_time"),
        F.when(F.col("event_type") == "view", "").otherwise("Hall").alias("building"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise("R1").alias("room"),
        F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd")).otherwise("").alias("start_date"),
        F.lit("").alias("end_date"),
        (F.col("event_type") == "error").alias("is_arranged"),
        (F.col("event_type") == "signup").alias("is_tba"),
    )
    return rows.withColumn("section_id", section_id(*[F.col(c) for c in ("term", "subject", "number", "crn")]))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section per user and week, described by its earliest event."""
    events = table(spark, sf_dir, "events")
    first = F.min(F.struct("event_id", "value")).getField
    grouped = events.groupBy(F.weekofyear("ts").alias("week"), "user_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        first("event_id").alias("first_id"), first("value").alias("first_value"),
    )
    rows = grouped.select(
        F.concat(F.lit("w"), F.col("week").cast("string")).alias("term"),
        F.lit("U").alias("subject"),
        (F.col("user_id") % 7).cast("string").alias("number"),
        F.col("user_id").cast("string").alias("crn"),
        F.when(F.col("first_id") % 5 == 0, "").otherwise(F.concat(F.lit("S"), F.col("user_id").cast("string"))).alias("section_number"),
        F.lit("1").alias("part_of_term"),
        F.date_format("first_ts", "yyyy-MM-dd").alias("start_date"),
        F.when(F.col("first_id") % 13 == 0, "").otherwise(F.date_format("last_ts", "yyyy-MM-dd")).alias("end_date"),
        F.when(F.col("first_value") >= 20, F.floor(F.col("first_value"))).cast("double").alias("credit_min"),
        F.when(F.col("first_value") >= 10, F.floor(F.col("first_value")) + 1).cast("double").alias("credit_max"),
        F.lit("").alias("credit_text"),
    )
    return rows.withColumn("section_id", section_id(*[F.col(c) for c in ("term", "subject", "number", "crn")]))
