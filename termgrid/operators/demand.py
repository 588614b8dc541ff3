"""Demand ranking of course-terms and the course summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgrid.functions.numbers import demand_proxy, flag, numeric, ratio
from termgrid.operators.normalize import scope_rows
from termgrid.operators.ordering import measure_counts, of_measure, quantile_from_counts, with_ranks
from termgrid.operators.quality import require_unique
from termgrid.sources.scratch import materialize
from termgrid.spec import (
    COUNT, COURSE_KEY, COURSE_TERM_KEY, FRACTION, HIGH_DEMAND_QUANTILE, MIN_DEMAND, PanelSpec,
    check_terms, check_window, require_columns,
)


@dataclass
class DemandTable:
    rows: DataFrame
    threshold: float
    quantile: float
    min_demand: int


def with_demand(df: DataFrame) -> DataFrame:
    """Demand = students + w, and the w share, from valid non-negative counts only."""
    students, w = numeric(df, "students"), numeric(df, "w")
    out = df.withColumns({"students": students, "w": w})
    out = out.withColumn("demand_proxy", demand_proxy(F.col("students"), F.col("w")))
    return out.withColumn("w_proxy", ratio(F.col("w"), F.col("demand_proxy")))


def demand_metrics(
    metrics: DataFrame,
    spec: PanelSpec | None = None,
    quantile: float = HIGH_DEMAND_QUANTILE,
    min_demand: int = MIN_DEMAND,
) -> DemandTable:
    """Course-term rows with demand, the high-demand flag and two exact ranks.

    The panel is materialised once at course-term grain; the quantile and both
    ranks then work on distinct values, so no step sorts all rows in one task.
    """
    spec = spec or PanelSpec()
    check_window(spec.window, spec), check_terms(spec.terms)
    quantile, min_demand = FRACTION.take(quantile, "quantile"), COUNT.take(min_demand, "min_demand")
    require_columns(metrics, [*COURSE_TERM_KEY, "students", "w"])

    work = with_demand(scope_rows(metrics, spec.window, spec.terms))
    share_if_rankable = F.when(F.col("demand_proxy") >= min_demand, F.col("w_proxy"))
    work = materialize(work.withColumn("_rankable_share", share_if_rankable), "course_terms")
    require_unique(work, COURSE_TERM_KEY, "metrics must have unique course-term keys")

    counts = measure_counts(work, ["demand_proxy", "_rankable_share"])
    threshold = of_measure(counts, "demand_proxy").agg(quantile_from_counts("_value", quantile).alias("q")).first()["q"]
    if threshold is None:
        raise ValueError("no valid student and w counts remain after filtering")
    ranked = with_ranks(work, {"demand_proxy": "demand_rank", "_rankable_share": "w_proxy_rank"}, counts)
    ranked = ranked.withColumn("is_high_demand", flag(F.col("demand_proxy") >= F.lit(threshold)))
    ranked = ranked.withColumn("w_proxy_rankable", F.col("_rankable_share").isNotNull())
    appended = ["demand_proxy", "is_high_demand", "demand_rank", "w_proxy_rankable", "w_proxy_rank"]
    kept = [c for c in metrics.columns if c not in appended]
    if "w_proxy" not in kept:
        kept.append("w_proxy")
    return DemandTable(ranked.select(*kept, *appended), threshold, quantile, min_demand)


def in_term_order(df: DataFrame, terms) -> DataFrame:
    """Sorted by year, calendar order of the terms, then the course key; nulls last."""
    position = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term"))
    order = [F.col("year"), F.when(position > 0, position), *[F.col(c) for c in COURSE_KEY]]
    return df.orderBy(*[c.asc_nulls_last() for c in order])


def demand_quality(course_terms: DataFrame) -> DataFrame:
    """One row of counts over a ``demand_metrics`` table."""
    demand = F.col("demand_proxy")
    return course_terms.agg(
        F.count_if(demand.isNull()).alias("rows_with_missing_or_negative_counts"),
        F.count_if(demand.isNotNull()).alias("rows_with_valid_demand_proxy"),
        F.count_if(F.col("w_proxy").isNotNull()).alias("rows_with_valid_w_proxy"),
        F.count_if(F.col("w_proxy_rankable")).alias("rows_rankable_for_w_proxy"),
    )


def course_summary(course_terms: DataFrame, min_demand: int = MIN_DEMAND) -> DataFrame:
    """One row per course with totals, weighted share and three exact ranks.

    A course holds at most window x terms rows, so its year set and median are
    bounded.  Everything is one aggregation; nothing is joined back.
    """
    min_demand = COUNT.take(min_demand, "min_demand")
    require_columns(
        course_terms,
        [*COURSE_KEY, "year", "term", "students", "w", "demand_proxy", "w_proxy", "is_high_demand"],
    )
    demand, share, high = F.col("demand_proxy"), F.col("w_proxy"), F.col("is_high_demand")
    years = F.array_sort(F.collect_set("year"))
    grouped = course_terms.groupBy(*COURSE_KEY).agg(
        F.count(F.lit(1)).alias("course_term_count"),
        years.alias("_years"),
        F.size(F.collect_set("term")).cast("long").alias("term_count"),
        F.sum("students").alias("students_total"),
        F.sum("w").alias("w_total"),
        F.sum(demand).alias("demand_proxy_total"),
        F.avg(demand).alias("demand_proxy_mean"),
        F.median(demand).alias("demand_proxy_median"),
        F.max(demand).alias("demand_proxy_max"),
        F.avg(share).alias("w_proxy_course_term_mean"),
        F.max(share).alias("w_proxy_course_term_max"),
        F.count(demand).alias("demand_valid_term_count"),
        F.count_if(high).alias("high_demand_term_count"),
        F.size(F.collect_set(F.when(high, F.col("year")))).cast("long").alias("high_demand_year_count"),
        F.sum(F.when(demand.isNotNull(), F.col("w"))).alias("_w_valid"),
    )
    total = F.col("demand_proxy_total")
    summary = grouped.withColumns({
        "year_count": F.size("_years").cast("long"),
        "years_observed": F.array_join(F.col("_years").cast("array<string>"), ","),
        "first_year": F.get("_years", F.lit(0)).cast("long"),
        "last_year": F.element_at("_years", -1).cast("long"),
        "w_proxy_weighted": ratio(F.col("_w_valid"), total),
        "high_demand_share": ratio(F.col("high_demand_term_count"), F.col("demand_valid_term_count")),
    })
    summary = summary.withColumn(
        "_rankable_share", F.when(total >= min_demand, F.col("w_proxy_weighted"))
    )
    summary = materialize(summary, "course_summary")
    summary = with_ranks(summary, {
        "demand_proxy_total": "demand_total_rank", "demand_proxy_mean": "demand_mean_rank", "_rankable_share": "w_proxy_weighted_rank",
    })
    summary = summary.withColumn("w_proxy_rankable", F.col("_rankable_share").isNotNull())
    return summary.select(
        *COURSE_KEY,
        "course_term_count", "year_count", "term_count", "years_observed", "first_year", "last_year",
        "students_total", "w_total", "demand_proxy_total", "demand_proxy_mean",
        "demand_proxy_median", "demand_proxy_max", "w_proxy_weighted",
        "w_proxy_course_term_mean", "w_proxy_course_term_max", "demand_valid_term_count",
        "high_demand_term_count", "high_demand_year_count", "high_demand_share",
        "demand_total_rank", "demand_mean_rank", "w_proxy_rankable", "w_proxy_weighted_rank",
    )


def in_rank_order(summary: DataFrame) -> DataFrame:
    return summary.orderBy(
        *[F.col(c).asc_nulls_last() for c in ("demand_total_rank", *COURSE_KEY)]
    )


def coverage(course_terms: DataFrame) -> DataFrame:
    return course_terms.groupBy("year", "term").agg(F.count(F.lit(1)).alias("rows"))


TOP_COLUMNS = (*COURSE_TERM_KEY, "students", "w", "demand_proxy", "w_proxy")


SHARE_TIES = ("demand_proxy", "subject", "number", "year", "term", "title")


def top_by_demand(course_terms: DataFrame, k: int = 10) -> DataFrame:
    """Largest demand first; ties by the full course-term key."""
    order = [F.col("demand_proxy").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in COURSE_TERM_KEY]]
    return course_terms.select(*TOP_COLUMNS).orderBy(*order).limit(k)


def top_by_share(course_terms: DataFrame, k: int = 10) -> DataFrame:
    """Largest w share among rankable rows; smaller demand first on ties, then the key."""
    order = [F.col("w_proxy").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in SHARE_TIES]]
    rows = course_terms.where(F.col("w_proxy_rankable"))
    return rows.select(*TOP_COLUMNS).orderBy(*order).limit(k)


def top_courses(summary: DataFrame, k: int = 10) -> DataFrame:
    order = [F.col("demand_proxy_total").desc_nulls_last(), F.col("demand_proxy_mean").desc_nulls_last()]
    order += [F.col(c).asc_nulls_last() for c in COURSE_KEY]
    return summary.select(
        *COURSE_KEY, "course_term_count", "year_count", "demand_proxy_total",
        "demand_proxy_mean", "w_proxy_weighted", "high_demand_year_count",
    ).orderBy(*order).limit(k)


def demand_report(table: DemandTable, summary: DataFrame) -> DataFrame:
    """The audit report as rows (section, position, key, value)."""
    rows = table.rows

    def text_key(columns):
        return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])

    def named(df: DataFrame, section: str) -> DataFrame:
        """A one-row frame of numbers as one report row per number."""
        doubles = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
        long = doubles.unpivot([], [F.col(c) for c in df.columns], "key", "value")
        return long.select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("position"), "key", "value")

    def top(df: DataFrame, section: str, keys, values, ties=None) -> DataFrame:
        # At most k rows: they are collected into one array, put in order there (nulls last) and numbered.
        by = [(c, -F.col(c)) for c in values] + [(c, F.col(c)) for c in ties or keys]
        order = [place for c, rising in by for place in (F.col(c).isNull().alias(f"no_{c}"), rising.alias(f"by_{c}"))]
        item = F.struct(*order, text_key(keys).alias("key"), F.col(values[0]).alias("value"))
        items = df.agg(F.array_sort(F.collect_list(item)).alias("items"))
        return items.select(
            F.lit(section).alias("section"), F.posexplode("items").alias("p", "item")
        ).select("section", (F.col("p") + 1).cast("long").alias("position"), "item.key", "item.value")

    sizes = rows.agg(
        F.count(F.lit(1)).alias("course_term_rows"),
        F.count("demand_proxy").alias("valid_demand_rows"),
        F.count("w_proxy").alias("valid_w_proxy_rows"),
    )
    courses = summary.agg(
        F.count(F.lit(1)).alias("course_rows"),
        (F.count_distinct("subject") + F.max(F.col("subject").isNull().cast("long"))).alias("subject_rows"),
    )
    parameters = rows.sparkSession.range(1).select(
        F.lit(table.quantile).alias("high_demand_quantile"),
        F.lit(table.threshold).alias("high_demand_threshold"),
        F.lit(table.min_demand).alias("min_demand_for_w_ranking"),
    )
    periods = coverage(rows).select(
        F.lit("coverage_by_year_term").alias("section"), F.lit(0).cast("long").alias("position"),
        text_key(("year", "term")).alias("key"), F.col("rows").cast("double").alias("value"),
    )
    parts = [
        named(sizes, "row_counts"),
        named(courses, "row_counts"),
        named(demand_quality(rows), "quality"),
        named(parameters, "ranking_parameters"),
        periods,
        top(top_by_demand(rows), "top_course_terms_by_demand", COURSE_TERM_KEY, ["demand_proxy"]),
        top(top_by_share(rows), "top_course_terms_by_w_proxy", COURSE_TERM_KEY, ["w_proxy"], SHARE_TIES),
        top(top_courses(summary), "top_courses_by_total_demand", COURSE_KEY, ["demand_proxy_total", "demand_proxy_mean"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
