"""Calendar lags of the stable-course panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termgrid.functions.numbers import ratio
from termgrid.spec import STABLE_KEY, TrajectorySpec, require_columns

LAG_FIELDS = ("w_flag", "w_mark_share", "demand_proxy", "students", "grade_point_mean")
NEEDED = ("demand_proxy", "w_proxy", "w_flag", "course_level", "title", "grade_point_mean")


def with_lags(metrics: DataFrame, years: TrajectorySpec | None = None, mode_from: str = "all") -> DataFrame:
    """Values of the same course 1..3 calendar years earlier; a gap stays null.

    A course seen in one term only is compared with that term of the earlier
    year, any other course with the earlier year as a whole.  One shuffle on the
    course key serves all lags: a range frame at year - k holds at most one row
    per term, so both readings come from the same window.

    ``mode_from="all"`` decides the comparison from all rows of a course,
    ``"history"`` only from rows before the holdout year.
    """
    years = years or TrajectorySpec()
    require_columns(metrics, [*STABLE_KEY, "year", "term", "w", "students", "grade_total", *NEEDED])
    if mode_from not in ("all", "history"):
        raise ValueError(f"unknown mode_from {mode_from!r}")
    course = Window.partitionBy(*STABLE_KEY)
    seen_term = F.col("term")
    if mode_from == "history":
        seen_term = F.when(F.col("year") < years.holdout_year, F.col("term"))
    one_term = F.min(seen_term).over(course) == F.max(seen_term).over(course)
    work = metrics.repartition(*[F.col(c) for c in STABLE_KEY])
    work = work.withColumn(
        "term_match_mode", F.when(one_term, F.lit("same_term")).otherwise(F.lit("any_term"))
    )
    columns, earlier = {}, {}
    work = work.withColumn("_points", F.col("grade_point_mean") * F.col("grade_total"))
    for lag in years.lags:
        then = course.orderBy("year").rangeBetween(-lag, -lag)

        def over(name: str, value):
            """A window value under a name: the expressions below name it several times, but it is worked out once."""
            earlier[f"_lag{lag}_{name}"] = value.over(then)
            return F.col(f"_lag{lag}_{name}")

        def same(field: str):
            """The field of the earlier row in this row's own term."""
            out = None
            for i, term in enumerate(years.terms):
                value = over(f"term{i}_{field}", F.max(F.when(F.col("term") == term, F.col(field))))
                out = F.when(F.col("term") == term, value) if out is None else out.when(F.col("term") == term, value)
            return out

        def total(field: str):
            """Sum over the earlier year; 0 if it has rows but no values, null if it has none."""
            rows = over("rows", F.count(F.lit(1)))
            return F.when(rows > 0, F.coalesce(over(f"sum_{field}", F.sum(field)), F.lit(0.0)))

        whole_year = {
            "w_flag": over("max_w_flag", F.max("w_flag")),
            "w_mark_share": ratio(total("w"), total("demand_proxy")),
            "demand_proxy": total("demand_proxy"),
            "students": total("students"),
            "grade_point_mean": ratio(total("_points"), total("grade_total")),
        }
        any_term = F.col("term_match_mode") == "any_term"
        for field in LAG_FIELDS:
            columns[f"lag{lag}_{field}"] = F.when(any_term, whole_year[field]).otherwise(same(field))
    work = work.withColumns(earlier).withColumns(columns).drop("_points", *earlier)
    flags = [F.col(f"lag{lag}_w_flag").isNotNull().cast("long") for lag in years.lags]
    seen = flags[0]
    for one in flags[1:]:
        seen = seen + one
    demand = F.col("lag1_demand_proxy")
    work = work.withColumns({f"lag{lag}_w_proxy": F.col(f"lag{lag}_w_mark_share") for lag in years.lags})
    work = work.withColumns({
        "history_year_count": seen,
        "has_three_same_term_years": seen == len(years.lags),
        "lag1_log_demand_proxy": F.when(demand >= 0, F.log1p(demand)),
        "split": F.when(F.col("year") == years.holdout_year, "holdout")
        .when(F.col("year").isin(*years.train_years), "train").otherwise("lag_initialization"),
    })
    return work.withColumn(
        "eligible_target", F.col("year").isin(*years.target_years) & F.col("has_three_same_term_years")
    )


def target_coverage(lagged: DataFrame, years: TrajectorySpec | None = None) -> DataFrame:
    """All and eligible rows per target year and term."""
    years = years or TrajectorySpec()
    rows = lagged.where(F.col("year").isin(*years.target_years))
    return rows.groupBy("year", "term").agg(
        F.count(F.lit(1)).alias("all_rows"), F.count_if("eligible_target").alias("eligible_rows")
    )


def annual_w(metrics: DataFrame) -> DataFrame:
    rows = metrics.dropna(subset=["year", "term"])
    return rows.groupBy("year", "term").agg(
        F.count(F.lit(1)).alias("course_term_rows"),
        F.sum("w_flag").alias("w_positive_rows"),
        F.avg("w_proxy").alias("w_proxy_mean"),
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("w_total"),
    )
