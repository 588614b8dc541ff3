"""Small interactive queries over the finished tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgrid.functions.numbers import ratio
from termgrid.functions.text import strip
from termgrid.operators.quality import null_safe_join
from termgrid.spec import COURSE_KEY, COURSE_TERM_KEY, MIN_DEMAND, STABLE_KEY

# Display names.
MODEL_LABELS = {
    "majority_baseline": "Majority baseline", "constant_baseline": "Constant baseline",
    "persistence_baseline": "Persistence baseline", "logistic_regression": "Logistic regression",
    "random_forest": "Random forest",
}
TERM_LABELS = {"spring": "Spring", "fall": "Fall"}
CLASS_LABELS = {
    "continuous_both_terms": "Continuous both terms", "seasonal_spring": "Spring-seasonal",
    "seasonal_fall": "Fall-seasonal", "intermittent": "Intermittent",
}
# Column names under which prediction files may carry each field.
PREDICTION_ALIASES = {
    "year": ("Year", "year", "target_year", "prediction_year"),
    "term": ("Term", "term", "season"),
    "subject": ("Subject", "subject", "subject_code"),
    "number": ("Number", "number", "course_number"),
    "title": ("Course Title", "course_title", "title"),
    "course_variant": ("course_variant", "variant", "title_variant"),
    "term_match_mode": ("term_match_mode", "history_term_rule"),
    "grade_point_mean": ("grade_point_mean", "estimated_grade_point_mean"),
    "instructor_count": ("instructor_count",),
    "instructors_observed": ("instructors_observed", "primary_instructors"),
    "actual_w": ("actual_w", "actual_w_mark", "actual_w_flag", "actual_high_w_risk", "actual", "y_true"),
    "predicted_probability": ("predicted_probability", "predicted_prob", "probability", "score", "prediction_score"),
    "predicted_w": ("predicted_w", "predicted_w_flag", "predicted_high_w_risk", "predicted", "y_pred"),
    "model": ("model",),
    "split": ("split",),
}
# Periods whose w totals are known to be unusual.
SPARSE_PERIODS = ((2020, "fall"), (2021, "spring"))


def labelled(column: Column, labels: Mapping[str, str]) -> Column:
    """Display name of a code; an unknown code shows as itself."""
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(pairs[column], column)


def course_label() -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(text("subject"), F.lit(" "), text("number"), F.lit(" · "), text("title"))


def filter_rows(course_terms: DataFrame, years: Iterable[int], terms: Iterable[str], subjects: Iterable[str] = ()) -> DataFrame:
    """Rows of the chosen years and terms; no subjects chosen means all."""
    rows = course_terms.where(F.col("year").isin(*years) & F.lower("term").isin(*terms))
    subjects = list(subjects)
    return rows.where(F.col("subject").isin(*subjects)) if subjects else rows


def restrict_summary(summary: DataFrame, course_terms: DataFrame) -> DataFrame:
    """Summary rows whose course occurs in the filtered rows."""
    return null_safe_join(summary, course_terms.select(*COURSE_KEY).distinct(), COURSE_KEY, "left_semi")


def kpis(rows: DataFrame) -> DataFrame:
    """One row: course-terms, distinct stable keys, students, w."""
    per_key = rows.groupBy(*STABLE_KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("students").alias("students"), F.sum("w").alias("w")
    )
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("course_terms"), F.count(F.lit(1)).alias("course_keys"),
        F.coalesce(F.sum("students"), F.lit(0.0)).alias("students"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"),
    )


def course_demand(rows: DataFrame) -> DataFrame:
    """Demand per stable key with its smallest non-blank title as display title."""
    title = strip(F.col("title"))
    grouped = rows.groupBy(*STABLE_KEY).agg(
        F.coalesce(F.min(F.when(title != "", title)), F.lit("")).alias("title"),
        F.coalesce(F.sum("demand_proxy"), F.lit(0.0)).alias("demand_proxy_total"),
        F.count(F.lit(1)).alias("course_term_count"),
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("w_total"),
    )
    return grouped.withColumn("w_proxy_weighted", ratio(F.col("w_total"), F.col("demand_proxy_total")))


def period_trend(rows: DataFrame) -> DataFrame:
    grouped = rows.dropna(subset=["year", "term"]).groupBy("year", "term").agg(
        F.coalesce(F.sum("demand_proxy"), F.lit(0.0)).alias("demand_proxy"),
        F.avg("w_mark_share").alias("w_mark_share"), F.count(F.lit(1)).alias("course_terms"),
    )
    label = F.concat(F.col("year").cast("string"), F.lit(" "), labelled(F.col("term"), TERM_LABELS))
    return grouped.withColumn("year_term", label)


def top_n(rows: DataFrame, n: int, value: str, ties: Sequence[str], min_demand: int | None = None) -> DataFrame:
    """The n largest values, ties in ascending order of the given columns."""
    if min_demand is not None:
        rows = rows.where(F.col("demand_proxy") >= min_demand)
    order = [F.col(value).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    return rows.where(F.col(value).isNotNull()).orderBy(*order).limit(n)


def top_stable_share(rows: DataFrame, n: int) -> DataFrame:
    return top_n(rows, n, "w_mark_share", COURSE_TERM_KEY, MIN_DEMAND)


def sample_rows(rows: DataFrame, limit: int = 5000, key: Sequence[str] = COURSE_TERM_KEY) -> DataFrame:
    """At most ``limit`` rows, the same ones whatever the row order (hash of the key)."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    order = F.sha2(F.concat_ws("|", *text), 256)
    return rows.withColumn("_order", order).orderBy("_order", *key).limit(limit).drop("_order")


def canonical_predictions(df: DataFrame) -> DataFrame:
    """Prediction columns under one set of names: the first alias present wins."""
    found = {}
    for name, candidates in PREDICTION_ALIASES.items():
        source = next((c for c in candidates if c in df.columns), None)
        if source:
            found[name] = F.col(f"`{source}`")
    for name in ("year", "term", "subject", "number", "title"):
        found.setdefault(name, F.lit(""))
    text = lambda name: F.coalesce(found[name].cast("string"), F.lit(""))
    course = F.concat(text("subject"), F.lit(" "), text("number")).alias("course")
    return df.select(*[column.alias(name) for name, column in found.items()], course)


def period_flags(annual: DataFrame, periods=SPARSE_PERIODS) -> DataFrame:
    """Periods of the annual w summary that are named as unusual, with their totals."""
    named = F.lit(False)
    for year, term in periods:
        named = named | ((F.col("year") == year) & (F.lower("term") == term))
    label = F.concat(F.col("year").cast("string"), F.lit(" "), labelled(F.lower("term"), TERM_LABELS))
    return annual.where(named).select("year", "term", label.alias("period"), "w_total")


def special_key_split(audit: DataFrame, continuity: DataFrame) -> DataFrame:
    """Special-topic keys, those that the panel retains, and those it lacks."""
    keys = audit.select(*STABLE_KEY).distinct()
    kept = continuity.select(*STABLE_KEY).distinct().withColumn("kept", F.lit(True))
    joined = null_safe_join(keys, kept, STABLE_KEY)
    kept_flag = F.col("kept").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(kept_flag).alias("overlap"),
        F.count_if(~kept_flag).alias("only"),
    )
