"""Leak-free course history, the risk label and the model feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termgrid.functions.numbers import course_level, numeric
from termgrid.operators.normalize import scope_rows, with_derived_shares
from termgrid.operators.ordering import quantile_from_counts, value_counts
from termgrid.operators.quality import require_unique, with_split
from termgrid.sources.scratch import materialize
from termgrid.spec import (
    COURSE_KEY, COURSE_TERM_KEY, FRACTION, HIGH_RISK_QUANTILE, SHARES, PanelSpec, require_columns,
)

HISTORY_MEANS = {
    "historical_w_proxy_mean": "w_proxy",
    "historical_demand_proxy_mean": "demand_proxy",
    "historical_students_mean": "students",
    "historical_grade_total_mean": "grade_total",
    **{f"historical_{share}": share for share in SHARES},
}
HISTORY_COLUMNS = (
    *[c for c in HISTORY_MEANS if "share_" not in c], "historical_term_count",
    *[c for c in HISTORY_MEANS if "share_" in c],
)
# Columns that carry the outcome and must never be model features.
LEAKAGE_COLUMNS = frozenset({
    "w", "w_proxy", "demand_proxy", "is_high_demand", "demand_rank", "w_proxy_rankable",
    "w_proxy_rank", "high_w_risk", "target", "split", "row_id",
})
CATEGORICAL_FEATURES = ("subject", "term")


def with_history(df: DataFrame) -> DataFrame:
    """Means of the annual means over strictly earlier years, per course.

    One shuffle on the course key serves every window.  Each year's mean is put
    on one row of that year, so a range frame that ends at year - 1 averages
    years, not rows, and nothing has to be joined back.  The windows of a year
    share one order, so that they are one operator, and a term counts on its
    first row of the year.
    """
    in_year = Window.partitionBy(*COURSE_KEY, "year").orderBy("term")
    whole_year = in_year.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.partitionBy(*COURSE_KEY).orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    work = df.repartition(*[F.col(c) for c in COURSE_KEY])
    work = work.withColumns({
        "_place": F.row_number().over(in_year), "_before": F.lag("term").over(in_year),
        **{f"_mean_{c}": F.avg(c).over(whole_year) for c in HISTORY_MEANS.values()},
    })
    new_term = F.col("term").isNotNull() & ~F.col("term").eqNullSafe(F.col("_before"))
    annual = {f"_year_{c}": F.when(F.col("_place") == 1, F.col(f"_mean_{c}")) for c in HISTORY_MEANS.values()}
    annual["_year_terms"] = new_term.cast("int")
    work = work.select(*df.columns, *[column.alias(name) for name, column in annual.items()])
    history = {name: F.avg(f"_year_{c}").over(earlier) for name, c in HISTORY_MEANS.items()}
    history["historical_term_count"] = F.sum("_year_terms").over(earlier).cast("double")
    return work.withColumns(history).drop(*annual)


@dataclass
class RiskLabel:
    quantile: float
    threshold: float
    strict: bool

    @property
    def operator(self) -> str:
        return ">" if self.strict else ">="

    def column(self):
        share = F.col("w_proxy")
        high = share > self.threshold if self.strict else share >= self.threshold
        return F.when(share.isNotNull(), high.cast("long"))


def risk_label(rows: DataFrame, quantile: float = HIGH_RISK_QUANTILE) -> RiskLabel:
    """Threshold from train rows only; strict when ``>=`` would label every train row."""
    quantile = FRACTION.take(quantile, "quantile")
    train = rows.where(F.col("split") == "train")
    counts = value_counts(train, "w_proxy").table
    row = counts.agg(
        quantile_from_counts("w_proxy", quantile).alias("threshold"), F.min("w_proxy").alias("lowest")
    ).first()
    if row["threshold"] is None:
        raise ValueError("training rows contain no valid w share")
    return RiskLabel(quantile, row["threshold"], row["threshold"] == row["lowest"])


@dataclass
class FeatureTable:
    rows: DataFrame
    label: RiskLabel
    spec: PanelSpec


def feature_table(metrics: DataFrame, spec: PanelSpec | None = None, quantile: float = HIGH_RISK_QUANTILE) -> FeatureTable:
    """Course-term rows with split, label, level and history features."""
    spec = spec or PanelSpec()
    require_columns(metrics, [*COURSE_TERM_KEY, "students", "w", "w_proxy", "demand_proxy"])
    FRACTION.take(quantile, "quantile")
    work = with_derived_shares(scope_rows(metrics, spec.window, spec.terms))
    work = work.withColumns({c: numeric(work, c) for c in ("w_proxy", "demand_proxy", "students")})
    work = with_split(work, spec)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COURSE_TERM_KEY]
    work = work.withColumns({
        "row_id": F.concat_ws("|", *parts),
        "course_level": course_level(F.col("number")),
        "year_offset": (F.col("year") - spec.window[0]).cast("long"),
    })
    work = materialize(with_history(work), "features")
    if work.isEmpty():
        raise ValueError("no rows remain after the window and term filter")
    require_unique(work, COURSE_TERM_KEY, "input must have unique course-term rows")
    label = risk_label(work, quantile)
    ordered = [
        "row_id", *COURSE_KEY, "year", "term", "split", "w", "students", "w_proxy", "demand_proxy",
        "high_w_risk", "course_level", "grade_total", *SHARES, *HISTORY_COLUMNS, "year_offset",
    ]
    return FeatureTable(work.withColumn("high_w_risk", label.column()).select(*ordered), label, spec)


def label_counts(rows: DataFrame) -> DataFrame:
    """Valid, positive and negative rows per split, and whether both classes occur."""
    label = F.col("high_w_risk")
    counts = rows.groupBy("split").agg(
        F.count(label).alias("valid_rows"),
        F.count_if(label == 1).alias("positive_rows"),
        F.count_if(label == 0).alias("negative_rows"),
    )
    both = (F.col("positive_rows") > 0) & (F.col("negative_rows") > 0)
    return counts.withColumn("class_status", F.when(both, "two_class").otherwise("one_class"))


def history_coverage(rows: DataFrame) -> DataFrame:
    """Report rows (split, measure, value): rows with history, non-null per feature."""
    any_history = F.coalesce(*[F.col(c) for c in HISTORY_COLUMNS]).isNotNull()
    wide = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_history).alias("rows_with_any_history"),
        F.count_if(~any_history).alias("rows_with_all_history_missing"),
        *[F.count(c).alias(c) for c in HISTORY_COLUMNS],
    )
    measures = [c for c in wide.columns if c != "split"]
    return wide.unpivot(["split"], measures, "measure", "value")


def model_features(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric features with any value, and categorical ones; outcome columns raise."""
    numeric_names = [c for c in ("year_offset", "course_level", *HISTORY_COLUMNS) if c in rows.columns]
    seen = rows.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in numeric_names]).first()
    numeric_names = [c for c in numeric_names if seen[c]]
    categorical = [c for c in CATEGORICAL_FEATURES if c in rows.columns]
    leaked = sorted(LEAKAGE_COLUMNS.intersection(numeric_names + categorical))
    if leaked:
        raise AssertionError(f"outcome columns chosen as features: {leaked}")
    return numeric_names, categorical
