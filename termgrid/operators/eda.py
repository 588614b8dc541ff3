"""Exploratory tables over the source rows and the stable panel."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgrid.functions.numbers import add, numeric
from termgrid.operators.ordering import quantile_from_counts, value_counts
from termgrid.sources.scratch import materialize
from termgrid.spec import MEASURES, SOURCE_ROW_KEY, STABLE_TERM_KEY


def _fingerprint(columns) -> list:
    """Two 64-bit hashes of a row; a text of its null places keeps (null, a) and (a, null) apart."""
    places = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(places, *columns).alias("_f1"), F.xxhash64(F.lit(1), *reversed(columns), places).alias("_f2")]


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, columns, full-row duplicates, missing cells, column types.

    Rows are grouped by a fingerprint of 16 bytes, map-side combined.  Only rows
    whose fingerprint occurs more than once are compared in full, so the count is
    exact, and a table without such rows is read once and never shuffled whole.
    Fingerprints that occur once are folded into one line before they are written.
    """
    out = None
    for name, df in tables.items():
        columns = [F.col(f"`{c}`") for c in df.columns]
        missing = add(c.isNull().cast("long") for c in columns)
        prints = df.groupBy(*_fingerprint(columns)).agg(F.count(F.lit(1)).alias("n"), F.sum(missing).alias("gaps"))
        again = F.col("n") > 1
        prints = materialize(prints.groupBy(
            again.alias("again"), F.when(again, F.col("_f1")).alias("_f1"), F.when(again, F.col("_f2")).alias("_f2"),
        ).agg(F.sum("n").alias("n"), F.sum("gaps").alias("gaps")), "fingerprints")
        repeated = prints.where("again").select("_f1", "_f2")
        facts = prints.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("missing_cells"))
        if repeated.isEmpty():
            facts = facts.withColumn("duplicate_rows", F.lit(0).cast("long"))
        else:
            suspects = df.select("*", *_fingerprint(columns)).join(repeated, ["_f1", "_f2"], "left_semi")
            sizes = suspects.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
            equal = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))
            # one row of totals beside one row of duplicates
            both = facts.unionByName(equal, allowMissingColumns=True)
            facts = both.agg(*[F.max(c).alias(c) for c in both.columns])
        part = facts.select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
            "duplicate_rows", "missing_cells", F.lit(json.dumps(dict(df.dtypes))).alias("dtypes"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def reconcile_periods(source: DataFrame, metrics: DataFrame) -> DataFrame:
    """Source against panel totals per period, absent sides as 0, with differences."""

    def totals(df: DataFrame, prefix: str) -> DataFrame:
        return df.dropna(subset=["year", "term"]).groupBy("year", "term").agg(
            F.count(F.lit(1)).alias(f"{prefix}_rows"),
            F.sum(numeric(df, "students")).alias(f"{prefix}_students"),
            F.sum(numeric(df, "w")).alias(f"{prefix}_w"),
        )

    both = totals(source, "source").join(totals(metrics, "metric"), ["year", "term"], "full_outer").na.fill(0)
    return both.withColumns({
        "students_total_difference": F.col("source_students") - F.col("metric_students"),
        "w_total_difference": F.col("source_w") - F.col("metric_w"),
    })


def subject_distribution(source: DataFrame) -> DataFrame:
    """Rows, distinct course numbers and totals per subject, largest first."""
    per_number = source.dropna(subset=["subject"]).groupBy("subject", "number").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(numeric(source, "students")).alias("students"), F.sum(numeric(source, "w")).alias("w"),
    )
    return per_number.groupBy("subject").agg(
        F.sum("rows").alias("source_rows"), F.count("number").alias("course_numbers"),
        F.coalesce(F.sum("students"), F.lit(0.0)).alias("students"),
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"),
    ).orderBy(F.col("source_rows").desc(), F.col("subject"))


def numeric_summary(source: DataFrame, fields=MEASURES) -> DataFrame:
    """Per field: non-null, missing, min, exact median, mean, max, unreadable entries.

    The rows are reduced to (field, value, count) once; every figure, the median
    included, comes from that table.
    """
    fields = [f for f in fields if f in source.columns]
    values = source.select(
        *[numeric(source, f).alias(f) for f in fields],
    )
    long = values.unpivot([], fields, "field", "value")
    counts = value_counts(long, "value", ["field"]).table
    stats = counts.groupBy("field").agg(
        F.sum("n").alias("non_null"), F.min("value").alias("min"),
        quantile_from_counts("value", 0.5).alias("median"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.max("value").alias("max"),
    )
    cells = source.agg(
        *[F.struct(
            F.count_if(numeric(source, f).isNull()).alias("missing"),
            F.count_if(F.col(f).isNotNull() & numeric(source, f).isNull()).alias("non_numeric_in_scope"),
        ).alias(f) for f in fields]
    ).unpivot([], fields, "field", "cells")
    return cells.join(stats, "field", "left").select(
        "field", F.coalesce("non_null", F.lit(0)).alias("non_null"), "cells.missing",
        "min", "median", "mean", "max", "cells.non_numeric_in_scope",
    )


def join_audit(
    source: DataFrame, metrics: DataFrame, key=STABLE_TERM_KEY, source_key=SOURCE_ROW_KEY,
    from_table: str = "six_year_spring_fall", to_table: str = "course_term_metrics",
) -> DataFrame:
    """One row: is source -> panel many-to-one on the course-term key?"""

    def groups(df: DataFrame, prefix: str) -> DataFrame:
        sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias(f"{prefix}_rows"), F.count_if(F.col("n") > 1).alias(f"{prefix}_groups"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias(f"{prefix}_repeats"),
        )

    # one row of each table's figures, folded into one
    both = groups(source, "source").unionByName(groups(metrics, "target"), allowMissingColumns=True)
    row = both.agg(*[F.max(c).alias(c) for c in both.columns])
    present = [c for c in source_key if c in source.columns]
    return row.select(
        F.lit(from_table).alias("from_table"), F.lit(to_table).alias("to_table"),
        F.lit(" + ".join(present)).alias("source_key_columns"), F.lit(" + ".join(key)).alias("target_key_columns"),
        F.lit("many_to_one").alias("relationship"), "source_rows", "target_rows",
        F.col("target_repeats").alias("target_key_duplicates"),
        F.col("source_groups").alias("source_groups_with_multiple_rows"),
        (F.col("target_repeats") == 0).alias("join_cardinality_valid"),
    )
