"""From raw grade rows to course-term metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgrid.functions.numbers import numeric, ratio, row_sum, weighted_sum
from termgrid.functions.text import term_name
from termgrid.sources.scratch import materialize
from termgrid.spec import (
    BAND_POINTS, BANDS, COURSE_TERM_KEY, MEASURES, SHARES, SOURCE_ROW_KEY, PanelSpec,
    check_terms, check_window, require_columns,
)


def year_number(df: DataFrame) -> Column:
    """The year as a number; an integer column is used as is, so filters push down."""
    if isinstance(df.schema["year"].dataType, T.IntegralType):
        return F.col("year")
    return numeric(df, "year")


def in_scope(df: DataFrame, years, terms) -> Column:
    return year_number(df).isin(*years) & term_name(F.col("term")).isin(*terms)


def scope_rows(df: DataFrame, years, terms) -> DataFrame:
    """Keep the years and terms, with a whole-number year and a clean term name."""
    rows = df.where(in_scope(df, years, terms))
    return rows.withColumns(
        {"year": year_number(df).cast("int"), "term": term_name(F.col("term"))}
    )


def normalize_rows(df: DataFrame, spec: PanelSpec | None = None, window=None, terms=None) -> DataFrame:
    """Window and term filter first, then the 15 measures as numbers."""
    spec = spec or PanelSpec()
    df = spec.canonical(df)
    window = check_window(window if window is not None else spec.window, spec)
    terms = check_terms(terms if terms is not None else spec.terms)
    require_columns(df, spec.columns)
    rows = scope_rows(df, window, terms)
    return rows.withColumns({c: numeric(rows, c) for c in MEASURES})


def with_grade_columns(metrics: DataFrame, shares: bool = True) -> DataFrame:
    """Band total, weighted mean of the grade points and, if wanted, band shares."""
    points = weighted_sum(BAND_POINTS)
    out = metrics.withColumn("grade_total", row_sum(BANDS))
    out = out.withColumn("grade_point_mean", ratio(points, F.col("grade_total")))
    if shares:
        out = out.withColumns({f"share_{b}": ratio(F.col(b), F.col("grade_total")) for b in BANDS})
    return out


def course_term_metrics(df: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
    """Sums per course and term; a group without any value sums to 0.

    One shuffle on the five keys, map-side combined.
    """
    spec = spec or PanelSpec()
    df = spec.canonical(df)
    require_columns(df, spec.columns)
    sums = df.groupBy(*COURSE_TERM_KEY).agg(
        *[F.coalesce(F.sum(numeric(df, c)), F.lit(0.0)).alias(c) for c in MEASURES]
    )
    metrics = with_grade_columns(sums)
    share = ratio(F.col("w"), F.col("w") + F.col("students"))
    metrics = metrics.withColumn("w_proxy", share).withColumn("w_mark_share", F.col("w_proxy"))
    return metrics.select(
        *COURSE_TERM_KEY, *BANDS, "w", "students", "w_proxy", "w_mark_share",
        "grade_total", "grade_point_mean", *SHARES,
    )


def with_derived_shares(df: DataFrame) -> DataFrame:
    """Band shares for a frame that may already hold some of them.

    A share column that is present wins; else it is count / grade_total; else null.
    """
    null = F.lit(None).cast("double")
    have = set(df.columns)
    counts = [b for b in BANDS if b in have]
    out = df.withColumns({b: numeric(df, b) for b in counts})
    if "grade_total" in have:
        out = out.withColumn("grade_total", numeric(df, "grade_total"))
    else:
        out = out.withColumn("grade_total", row_sum(counts) if counts else null)
    shares = {}
    for band, share in zip(BANDS, SHARES):
        if share in have:
            shares[share] = numeric(df, share)
        elif band in have:
            shares[share] = ratio(F.col(band), F.col("grade_total"))
        else:
            shares[share] = null
    return out.withColumns(shares)


def duplicate_rows(df: DataFrame, keys) -> DataFrame:
    """One row: how many rows share their key with another row (nulls are equal)."""
    groups = df.groupBy(*keys).count()
    return groups.where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"))


def source_profile(raw: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
    """The counts of a quality report per source row key, from one map-side combined pass over the raw rows.

    ``missing_<column>`` and ``unreadable_<measure>`` count rows in scope, measures after coercion.
    """
    spec = spec or PanelSpec()
    raw = spec.canonical(raw)
    require_columns(raw, spec.columns)
    scope = in_scope(raw, spec.window, spec.terms)
    measures = {c: numeric(raw, c) for c in MEASURES}
    missing = {c: measures.get(c, F.col(c)).isNull() for c in raw.columns}
    counts = raw.groupBy(*SOURCE_ROW_KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(scope).alias("rows_in_scope"),
        *[F.count_if(scope & absent).alias(f"missing_{c}") for c, absent in missing.items()],
        *[F.count_if(scope & F.col(c).isNotNull() & value.isNull()).alias(f"unreadable_{c}") for c, value in measures.items()],
    )
    return counts.withColumns({"year": year_number(counts).cast("int"), "term": term_name(F.col("term"))})


def quality_report(raw: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
    """Report rows (section, field, value): sizes, missing cells, unreadable numbers.

    The raw rows are read once; every figure comes from their profile by source row key.
    """
    profile = materialize(source_profile(raw, spec), "profile")
    columns = [c.removeprefix("missing_") for c in profile.columns if c.startswith("missing_")]
    totals = profile.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in profile.columns if c not in SOURCE_ROW_KEY],
        F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows"))), F.lit(0)).alias("duplicate_rows"),
    )
    terms = profile.where("rows_in_scope > 0").select(*COURSE_TERM_KEY).distinct().agg(F.count(F.lit(1)).alias("course_term_rows"))

    def entry(section: str, field: str, value: str):
        return F.struct(F.lit(section).alias("section"), F.lit(field).alias("field"), F.col(value).cast("long").alias("value"))

    figures = totals.select(F.inline(F.array(
        entry("rows", "raw_rows", "rows"), entry("rows", "filtered_rows", "rows_in_scope"),
        entry("rows", "duplicate_rows", "duplicate_rows"),
        *[entry("filtered_missing", c, f"missing_{c}") for c in columns],
        *[entry("raw_non_numeric_in_scope", c, f"unreadable_{c}") for c in MEASURES],
    )))
    return figures.unionByName(terms.select(F.inline(F.array(entry("rows", "course_term_rows", "course_term_rows")))))
