"""The stable-course panel (subject + number) and its audits.

Titles are display only: an edited title never makes a new course.  Rows with a
rotating special-topics title are set aside before aggregation and audited.

``title_rows`` is the one pass over the raw rows.  It sums them per course-term
and raw title, map-side combined; every other table here works on that much
smaller frame, so title expressions run once per distinct title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgrid.functions.numbers import course_level, flag, numeric, ratio
from termgrid.functions.text import is_special_topic, joined, strip, title_norm
from termgrid.operators.entries import numbered_entries
from termgrid.operators.normalize import scope_rows, with_grade_columns
from termgrid.operators.quality import null_safe_join
from termgrid.spec import (
    BANDS, MEASURES, STABLE_KEY, STABLE_TERM_KEY, PanelSpec, TrajectorySpec, require_columns,
)


def raw_scope(raw: DataFrame, years: TrajectorySpec | None = None, panel: PanelSpec | None = None) -> DataFrame:
    """Rows of the source years and terms, under the library's column names."""
    years, panel = years or TrajectorySpec(), panel or PanelSpec()
    raw = panel.canonical(raw)
    require_columns(raw, [*STABLE_TERM_KEY, "students", "w"])
    return scope_rows(raw, years.source_years, years.terms)


def title_rows(raw: DataFrame, years: TrajectorySpec | None = None, panel: PanelSpec | None = None) -> DataFrame:
    """Sums and row counts per course-term and raw title, with the special-topic flag."""
    rows = raw_scope(raw, years, panel)
    null = F.lit(None)
    have = set(rows.columns)
    rows = rows.withColumns({
        c: numeric(rows, c) if c in have else null.cast("double") for c in MEASURES
    })
    if "title" not in have:
        rows = rows.withColumn("title", null.cast("string"))
    sums = rows.groupBy(*STABLE_TERM_KEY, "title").agg(
        *[F.sum(c).alias(c) for c in MEASURES], F.count(F.lit(1)).alias("source_rows")
    )
    return sums.withColumn("is_special", is_special_topic(F.col("title")))


def display_title(rows: DataFrame) -> DataFrame:
    """Most frequent trimmed title per course-term; the smallest text on ties."""
    counts = (
        rows.where(F.col("title").isNotNull())
        .withColumn("title", strip(F.col("title")))
        .groupBy(*STABLE_TERM_KEY, "title").agg(F.sum("source_rows").alias("rows"))
    )
    best = counts.groupBy(*STABLE_TERM_KEY).agg(
        F.min(F.struct((-F.col("rows")).alias("rank"), F.col("title"))).getField("title").alias("title")
    )
    return best


def stable_terms(titles: DataFrame) -> DataFrame:
    """One row per course-term of the stable key; a group without values stays null."""
    ordinary = titles.where(~F.col("is_special"))
    # Titles that differ only in outer blanks are one title for the display choice.
    by_title = ordinary.withColumn("title", strip(F.col("title"))).groupBy(*STABLE_TERM_KEY, "title").agg(
        *[F.sum(c).alias(c) for c in MEASURES], F.sum("source_rows").alias("source_rows")
    )
    best_title = F.min(F.when(
        F.col("title").isNotNull(), F.struct((-F.col("source_rows")).alias("rank"), F.col("title"))
    )).getField("title")
    sums = by_title.groupBy(*STABLE_TERM_KEY).agg(
        *[F.sum(c).alias(c) for c in MEASURES], F.coalesce(best_title, F.lit("")).alias("title")
    )
    metrics = with_grade_columns(sums, shares=False)
    metrics = metrics.withColumn("demand_proxy", F.col("students") + F.col("w"))
    metrics = metrics.withColumn("w_proxy", ratio(F.col("w"), F.col("demand_proxy")))
    return metrics.select(
        *STABLE_TERM_KEY, F.lit("base").alias("course_variant"), *BANDS, "w", "students", "title",
        "grade_total", "grade_point_mean", "demand_proxy", "w_proxy",
        F.col("w_proxy").alias("w_mark_share"),
        flag(F.col("w") > 0).cast("long").alias("w_flag"),
        course_level(F.col("number"), negative_is_zero=True).alias("course_level"),
    )


def special_topic_audit(titles: DataFrame) -> DataFrame:
    rows = titles.where(F.col("is_special"))
    return rows.select(
        *STABLE_TERM_KEY, "title", "source_rows",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("students", "w")],
    )


def special_key_counts(titles: DataFrame) -> DataFrame:
    """One row: keys with special rows, keys with only such rows, keys with both kinds."""
    keys = titles.groupBy(*STABLE_KEY).agg(
        F.max("is_special").alias("special"), F.max(~F.col("is_special")).alias("ordinary")
    )
    special, ordinary = F.col("special"), F.col("ordinary")
    return keys.agg(
        F.count_if(special).alias("special_topic_course_keys_with_rows"),
        F.count_if(special & ~ordinary).alias("special_topic_only_course_keys_excluded"),
        F.count_if(special & ordinary).alias("special_topic_overlap_course_keys_retained"),
    )


def instructor_audit(raw: DataFrame, years: TrajectorySpec | None = None, panel: PanelSpec | None = None) -> DataFrame:
    """Distinct instructors per course-term; names are reduced before they are collected."""
    rows = raw_scope(raw, years, panel)
    if "title" in rows.columns:
        rows = rows.where(~is_special_topic(F.col("title")))
    if "instructor" not in rows.columns:
        rows = rows.limit(0).withColumn("instructor", F.lit(None).cast("string"))
    per_name = rows.groupBy(*STABLE_TERM_KEY, "instructor").agg(F.count(F.lit(1)).alias("rows"))
    return per_name.groupBy(*STABLE_TERM_KEY).agg(
        F.count("instructor").alias("instructor_count"),
        joined(F.collect_set(strip(F.col("instructor"))), " | ").alias("instructors_observed"),
        F.sum("rows").alias("source_rows"),
    )


def with_instructors(metrics: DataFrame, audit: DataFrame) -> DataFrame:
    return null_safe_join(metrics, audit.drop("source_rows"), STABLE_TERM_KEY)


def title_audit(titles: DataFrame) -> DataFrame:
    """All distinct raw titles of the ordinary rows per stable course key."""
    distinct = titles.where(~F.col("is_special")).select(*STABLE_KEY, "title").distinct()
    audit = distinct.groupBy(*STABLE_KEY).agg(
        F.count("title").alias("title_count"),
        F.array_join(F.array_sort(F.collect_list("title")), " | ").alias("titles_observed"),
    )
    return audit.select(
        *STABLE_KEY, F.lit("base").alias("course_variant"), "title_count", "titles_observed",
        (F.col("title_count") > 1).alias("title_changed"),
    )


def title_entries(titles: DataFrame) -> DataFrame:
    """The distinct raw titles of the ordinary rows as rows: key, ordinal, title."""
    return numbered_entries(titles.where(~F.col("is_special")), STABLE_KEY, "title")


def instructor_entries(raw: DataFrame, years: TrajectorySpec | None = None, panel: PanelSpec | None = None) -> DataFrame:
    """The distinct instructors of a course-term as rows: key, ordinal, instructor."""
    rows = raw_scope(raw, years, panel)
    rows = rows.where(~is_special_topic(F.col("title"))).withColumn("instructor", strip(F.col("instructor")))
    return numbered_entries(rows.where("instructor <> ''"), STABLE_TERM_KEY, "instructor")


def title_change_counts(titles: DataFrame, years: TrajectorySpec | None = None) -> DataFrame:
    """One row of title-change counters over normalised titles.

    The periods a title was seen in are a bit mask, so "the title sets of two
    years differ" is "some title misses a year the course was offered in":
    bit_and of the masks differs from bit_or.  No title set is collected.
    """
    years = years or TrajectorySpec()
    year_bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("year") - years.source_years[0])
    normal = titles.where(~F.col("is_special")).withColumn("title", title_norm(F.col("title")))
    per_title = normal.groupBy(*STABLE_KEY, "title").agg(F.bit_or(year_bit).alias("mask"))
    per_key = per_title.groupBy(*STABLE_KEY).agg(
        F.count(F.lit(1)).alias("titles"), F.bit_and("mask").alias("always"), F.bit_or("mask").alias("ever")
    )
    keys = per_key.agg(
        F.count(F.lit(1)).alias("course_keys"),
        F.count_if(F.col("titles") > 1).alias("multi_title_base_count"),
        F.count_if(F.col("always") != F.col("ever")).alias("cross_year_title_change_base_key_count"),
    )
    per_term = (
        normal.select(*STABLE_TERM_KEY, "title").distinct()
        .groupBy(*STABLE_TERM_KEY).agg(F.count(F.lit(1)).alias("titles")).where("titles > 1")
        .groupBy(*STABLE_KEY).agg(F.count(F.lit(1)).alias("terms"))
        .agg(F.count(F.lit(1)).alias("collision_base_key_count"),
             F.coalesce(F.sum("terms"), F.lit(0)).alias("collision_course_term_count"))
    )
    long = keys.unpivot([], keys.columns, "counter", "value").unionByName(
        per_term.unpivot([], per_term.columns, "counter", "value")
    )
    return long


def scope_counts(raw: DataFrame, titles: DataFrame, metrics: DataFrame) -> DataFrame:
    """Report rows (counter, value): sizes before and after the special-topic filter."""
    rows = F.col("source_rows")
    special = F.col("is_special")
    counts = titles.agg(
        F.sum(rows).alias("raw_rows_in_scope"),
        F.coalesce(F.sum(F.when(~special, rows)), F.lit(0)).alias("included_rows_in_scope"),
        F.coalesce(F.sum(F.when(special, rows)), F.lit(0)).alias("special_topic_raw_rows_excluded"),
    )
    total = raw.agg(F.count(F.lit(1)).alias("raw_input_rows"))
    terms = metrics.agg(F.count(F.lit(1)).alias("course_term_rows"))
    parts = [df.unpivot([], df.columns, "counter", "value") for df in (total, counts, terms)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def audit_counts(
    raw: DataFrame, titles: DataFrame, metrics: DataFrame, periods: DataFrame,
    years: TrajectorySpec | None = None, panel: PanelSpec | None = None,
) -> DataFrame:
    """Report rows (counter, value): what the audits hold and whether sources and panel agree.

    ``periods`` are the reconciled totals of ``eda.reconcile_periods``.  One grouping
    over the title rows gives every counter of audits; flags count as 0 and 1; the
    missing instructors are null where the source has no such column.
    """
    special = F.col("is_special")
    terms = titles.groupBy(*STABLE_TERM_KEY).agg(
        F.count_if(special).alias("special"), F.count_if(~special).alias("ordinary")
    )
    keys = terms.groupBy(*STABLE_KEY).agg(
        F.sum("special").alias("special"), F.count_if(F.col("special") > 0).alias("special_terms"),
        F.sum("ordinary").alias("ordinary"), F.count_if(F.col("ordinary") > 0).alias("ordinary_terms"),
    )
    zero = lambda column: F.coalesce(F.sum(column), F.lit(0))
    audits = keys.agg(
        zero("special").alias("special_topic_audit_rows"),
        zero("special_terms").alias("special_topic_course_terms_with_rows"),
        F.count_if(F.col("ordinary") > 0).alias("title_audit_rows"),
        zero("ordinary_terms").alias("instructor_audit_rows"),
    )
    variants = metrics.groupBy(*STABLE_KEY, "course_variant").count().agg(F.count(F.lit(1)).alias("variant_count"))
    agree = F.coalesce(
        F.bool_and((F.col("students_total_difference") == 0) & (F.col("w_total_difference") == 0)), F.lit(True))
    reconciled = periods.agg(agree.cast("long").alias("reconciliation_all_zero"))
    scope = raw_scope(raw, years, panel)
    missing = F.count_if(F.col("instructor").isNull()) if "instructor" in scope.columns else F.lit(None).cast("long")
    people = scope.agg(missing.alias("instructor_missing_source_rows_in_scope"))
    if "instructor" not in scope.columns:
        audits = audits.withColumn("instructor_audit_rows", F.lit(0).cast("long"))
    parts = [df.unpivot([], df.columns, "counter", "value") for df in (audits, variants, reconciled, people)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
