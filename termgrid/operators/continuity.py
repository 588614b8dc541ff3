"""Offering continuity per stable course.  Absent terms are never made up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgrid.spec import STABLE_KEY, TrajectorySpec, require_columns


def _text(years: Column) -> Column:
    return F.array_join(years.cast("array<string>"), ", ")


def _longest_run(years: Column) -> Column:
    """Longest run of consecutive years in a sorted array of distinct years."""
    start = F.struct(
        F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")
    )

    def step(state, year):
        run = F.when(state["last"] + 1 == year, state["run"] + 1).otherwise(F.lit(1))
        return F.struct(
            year.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best")
        )

    return F.aggregate(years, start, step, lambda state: state["best"]).cast("long")


def course_continuity(metrics: DataFrame, years: TrajectorySpec | None = None) -> DataFrame:
    """One row per course: years and terms seen, runs, class, eligibility, exclusion reason.

    A course has at most years x terms distinct periods, so the collected set is
    bounded; one shuffle on the course key.
    """
    years = years or TrajectorySpec()
    require_columns(metrics, [*STABLE_KEY, "year", "term", "course_variant"])
    spring, fall = years.terms
    period = F.struct(F.col("year").alias("year"), F.lower("term").alias("term"))
    grouped = metrics.groupBy(*STABLE_KEY).agg(
        F.array_sort(F.collect_set(period)).alias("periods"),
        F.size(F.collect_set(F.col("term"))).alias("term_count"),
    )

    def seen_in(term: str) -> Column:
        return F.transform(F.filter("periods", lambda p: p["term"] == term), lambda p: p["year"])

    primary = F.filter("periods", lambda p: p["year"].isin(*years.primary_years))
    bridge = F.filter("periods", lambda p: p["year"] == years.holdout_year)
    work = grouped.withColumns({
        "years": F.array_distinct(F.transform("periods", lambda p: p["year"])),
        "spring": seen_in(spring),
        "fall": seen_in(fall),
        "primary_periods": primary,
        "primary_years": F.array_distinct(F.transform(primary, lambda p: p["year"])),
        "bridge": F.transform(bridge, lambda p: p["term"]),
    })
    expected = len(years.source_years) * len(years.terms)
    all_years = len(years.source_years)
    n_spring, n_fall = F.size("spring"), F.size("fall")
    continuity_class = (
        F.when(F.size("periods") == expected, "continuous_both_terms")
        .when((n_fall == 0) & (n_spring == all_years), "seasonal_spring")
        .when((n_spring == 0) & (n_fall == all_years), "seasonal_fall")
        .otherwise("intermittent")
    )

    def covered(target: int) -> Column:
        """All lag years of a target are there: in one term, or in any for two-term courses."""
        need = F.array(*[F.lit(target - lag) for lag in years.lags])

        def within(array: str) -> Column:
            return F.size(F.array_except(need, F.col(array))) == 0

        one_term = F.col("term_match_mode") == "same_term"
        return F.when(one_term, within("spring") | within("fall")).otherwise(within("years"))

    work = work.withColumns({
        "continuity_class": continuity_class,
        "term_match_mode": F.when(F.col("term_count") == 1, "same_term").otherwise("any_term"),
    })
    work = work.withColumns({f"covered_{t}": covered(t) for t in years.target_years})
    eligible = F.col(f"covered_{years.holdout_year}")
    trained = F.greatest(*[F.col(f"covered_{t}") for t in years.train_years])
    reason = (
        F.when(eligible, "")
        .when(F.size("years") < years.min_history_years, "fewer_than_minimum_observed_years")
        .when(F.col("term_match_mode") == "same_term", "seasonal_series_lacks_three_same_term_history")
        .otherwise("ordinary_series_lacks_three_prior_year_history")
    )
    terms_seen = F.filter(
        F.array(*[F.lit(t) for t in years.terms]), lambda t: F.exists("periods", lambda p: p["term"] == t)
    )
    labels = F.transform("periods", lambda p: F.concat(p["year"].cast("string"), F.lit(" "), p["term"]))

    def count(array) -> Column:
        return F.size(array).cast("long")

    return work.select(
        *STABLE_KEY, F.lit("base").alias("course_variant"),
        _text(F.col("years")).alias("observed_years"),
        F.array_join(terms_seen, ", ").alias("observed_terms"),
        F.array_join(labels, " | ").alias("observed_periods"),
        count("years").alias("observed_year_count"),
        count("periods").alias("observed_period_count"),
        F.lit(expected).cast("long").alias("expected_period_count"),
        (F.size("periods") / F.lit(float(expected))).alias("period_coverage"),
        n_spring.cast("long").alias("spring_count"), n_fall.cast("long").alias("fall_count"),
        _text(F.col("spring")).alias("spring_years"), _text(F.col("fall")).alias("fall_years"),
        _longest_run(F.col("spring")).alias("max_consecutive_spring_years"),
        _longest_run(F.col("fall")).alias("max_consecutive_fall_years"),
        "continuity_class", "term_match_mode",
        count("primary_years").alias("primary_observed_year_count"),
        count("primary_periods").alias("primary_observed_period_count"),
        _text(F.col("primary_years")).alias("primary_years"),
        F.array_join("bridge", ", ").alias("bridge_terms"),
        (F.col("continuity_class") != "continuous_both_terms").alias("is_seasonal_or_intermittent"),
        trained.alias("training_eligible"), eligible.alias("backtest_eligible"),
        *[F.col(f"covered_{t}").alias(f"same_term_history_{t}") for t in years.target_years],
        reason.alias("excluded_reason"),
    )


def distribution(continuity: DataFrame, column: str) -> DataFrame:
    """Courses per value of a low-cardinality column, their share, median observed periods."""
    groups = continuity.groupBy(column).agg(
        F.count(F.lit(1)).alias("course_count"),
        F.median("observed_period_count").alias("median_observed_periods"),
    )
    # The window sees one row per class or period count, a number fixed by the spec.
    total = F.sum("course_count").over(Window.partitionBy(F.lit(1)))
    shares = groups.withColumn("share", F.col("course_count") / total)
    return shares.where(F.col(column).isNotNull()).select(
        column, "course_count", "share", "median_observed_periods"
    )


def excluded_courses(continuity: DataFrame, limit: int = 100) -> DataFrame:
    """Intermittent courses outside the backtest, first by course key."""
    rows = continuity.where(~F.col("backtest_eligible") & (F.col("continuity_class") == "intermittent"))
    return rows.select(
        *STABLE_KEY, "observed_period_count", "observed_year_count", "spring_count", "fall_count",
        "term_match_mode", "observed_periods", "continuity_class", "backtest_eligible", "excluded_reason",
    ).orderBy(*[F.col(c).asc_nulls_last() for c in STABLE_KEY]).limit(limit)
