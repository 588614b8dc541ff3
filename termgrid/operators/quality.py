"""Key contracts, table validation, time splits and window choice."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgrid.functions.numbers import flag, numeric
from termgrid.functions.text import term_name
from termgrid.operators.normalize import year_number
from termgrid.sources.scratch import materialize
from termgrid.spec import COURSE_TERM_KEY, MEASURES, SHARES, PanelSpec, check_window

TOLERANCE = 1e-6


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], message: str = "keys must be unique") -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(message)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which a null key matches a null key."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def join_with_contract(left: DataFrame, right: DataFrame, keys: Sequence[str], contract: str = "m:1") -> DataFrame:
    """Left join that first checks the declared cardinality ("m:1" or "1:1")."""
    if contract not in ("m:1", "1:1"):
        raise ValueError(f"unknown contract {contract!r}")
    require_unique(right, keys, f"right side is not unique on {list(keys)}")
    if contract == "1:1":
        require_unique(left, keys, f"left side is not unique on {list(keys)}")
    return null_safe_join(left, right, keys)


def _whole_year(df: DataFrame) -> Column:
    year = year_number(df)
    return year.isNotNull() & (year == F.floor(year))


def _split_counts(df: DataFrame, window) -> list[Column]:
    year = year_number(df)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(~flag(_whole_year(df) & year.isin(*window))).alias("bad"),
        F.count_if(year.isin(*window[:2])).alias("train"),
        F.count_if(year == window[2]).alias("holdout"),
    ]


def with_split(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``train`` for the first two window years, ``holdout`` for the rest."""
    return df.withColumn(
        "split", F.when(F.col("year").isin(*spec.train_years), "train").otherwise("holdout")
    )


def split_by_window(df: DataFrame, spec: PanelSpec) -> tuple[DataFrame, DataFrame]:
    """Strict time split: unreadable, foreign or one-sided years raise."""
    if "year" not in df.columns:
        raise ValueError("metrics must have a year column")
    window = check_window(spec.window, spec)
    counts = df.agg(*_split_counts(df, window)).first()
    if counts["n"] == 0:
        raise ValueError("metrics must not be empty")
    if counts["bad"]:
        raise ValueError("years must be whole numbers within the window")
    if not counts["train"] or not counts["holdout"]:
        raise ValueError("a side of the split is empty")
    year = year_number(df)
    return df.where(year.isin(*window[:2])), df.where(year == window[2])


# The checks of a validation, in report order, each from the facts of the two tables.
_FACT_TYPES = {
    "rows": "long", "bad_years": "long", "bad_terms": "long", "bad_shares": "long", "repeated_keys": "long",
    "bad_split": "long", "train_rows": "long", "holdout_rows": "long", "totals": "array<double>",
}


def table_facts(df: DataFrame, name: str, spec: PanelSpec, keys: Sequence[str] = ()) -> DataFrame:
    """One row of counts and column totals for all checks of a table, from one read of it.

    A fact whose column the table lacks is null.  With ``keys`` the rows are grouped
    by them first, and repeated keys counted over the groups.
    """
    df = spec.canonical(df)
    has = set(df.columns)
    year = year_number(df) if "year" in has else None
    facts = {"rows": F.count(F.lit(1))}
    if year is not None:
        facts["bad_years"] = F.count_if(~flag(year.isin(*spec.window)))
        _, facts["bad_split"], facts["train_rows"], facts["holdout_rows"] = _split_counts(df, spec.window)
    if "term" in has:
        facts["bad_terms"] = F.count_if(~flag(term_name(F.col("term")).isin(*spec.terms)))
    if "w_proxy" in has:
        facts["bad_shares"] = F.count_if(~numeric(df, "w_proxy").between(0, 1))
    summed = all(c in has for c in MEASURES)
    sums = {f"total_{c}": F.coalesce(F.sum(numeric(df, c)), F.lit(0.0)) for c in MEASURES} if summed else {}
    partial = {**facts, **sums}
    if keys and set(keys) <= has:
        groups = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(*[c.alias(k) for k, c in partial.items()])
        partial = {k: F.coalesce(F.sum(k), F.lit(0)) for k in partial}
        partial["repeated_keys"] = F.count_if(F.col("rows") > 1)
        df = groups
    row = df.agg(*[c.alias(k) for k, c in partial.items()])
    row = row.withColumn("totals", F.array(*sums) if summed else F.lit(None))
    have = set(row.columns)
    return row.select(F.lit(name).alias("table"), *[
        (F.col(k) if k in have else F.lit(None)).cast(t).alias(k) for k, t in _FACT_TYPES.items()])


@dataclass
class Validation:
    """``checks``: rows (check, passed, detail).  ``summary``: one row with verdict and row counts."""

    checks: DataFrame
    summary: DataFrame


def validation(filtered: DataFrame, metrics: DataFrame, spec: PanelSpec | None = None) -> Validation:
    """Checks of the two tables and their verdict; each table is read once, and nothing raises.

    Only the facts, one row a table, are kept between the report's parts.
    """
    spec = spec or PanelSpec()
    tables = {"filtered": spec.canonical(filtered), "metrics": spec.canonical(metrics)}
    needed = {
        "filtered": list(spec.columns),
        "metrics": [*COURSE_TERM_KEY, *MEASURES, "grade_total", "w_proxy", *SHARES],
    }
    missing = {name: [c for c in needed[name] if c not in tables[name].columns] for name in tables}
    keys = {"filtered": (), "metrics": COURSE_TERM_KEY}
    facts = [table_facts(df, name, spec, keys[name]) for name, df in tables.items()]
    facts = materialize(facts[0].unionByName(facts[1]), "facts")
    both = facts.agg(*[
        F.max(F.when(F.col("table") == name, F.struct(*_FACT_TYPES))).alias(name) for name in tables])

    def none(fact: str) -> Column:
        return F.coalesce(F.col(fact) == 0, F.lit(False))

    gaps = F.zip_with("filtered.totals", "metrics.totals", lambda a, b: F.abs(a - b))
    checks = {}
    for name in tables:
        checks[f"{name}_has_required_columns"] = F.lit(not missing[name])
        checks[f"{name}_year_in_window"] = none(f"{name}.bad_years")
        checks[f"{name}_term_in_terms"] = none(f"{name}.bad_terms")
    checks["metrics_w_proxy_in_range"] = none("metrics.bad_shares")
    checks["metrics_group_keys_unique"] = none("metrics.repeated_keys")
    checks["split_by_window"] = none("metrics.bad_split") & flag(
        (F.col("metrics.train_rows") > 0) & (F.col("metrics.holdout_rows") > 0))
    checks["column_sums_match"] = flag(F.array_max(gaps) <= TOLERANCE)
    split_count = lambda fact: F.when(F.col("split_by_window"), F.col(fact)).otherwise(0)
    row = both.withColumns(checks)
    summary = row.select(
        reduce(lambda a, b: a & b, [F.col(c) for c in checks]).alias("passed"),
        F.array_join(F.filter(F.array(*[F.when(~F.col(c), F.lit(c)) for c in checks]), lambda c: c.isNotNull()), ";").alias("errors"),
        F.col("filtered.rows").alias("filtered_rows"), F.col("metrics.rows").alias("metrics_rows"),
        split_count("metrics.train_rows").alias("train_rows"), split_count("metrics.holdout_rows").alias("holdout_rows"),
    )
    detail = F.when(F.col("passed"), "")
    for name in tables:
        detail = detail.when(
            F.col("check") == f"{name}_has_required_columns", "missing: " + ", ".join(missing[name])
        )
    rows = row.select(*checks).unpivot([], [F.col(c) for c in checks], "check", "passed")
    return Validation(rows.withColumn("detail", detail.otherwise("failed")), summary)


def validate_tables(filtered: DataFrame, metrics: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
    """The report rows (check, passed, detail) of ``validation``."""
    return validation(filtered, metrics, spec).checks


def time_split_counts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows per split and year."""
    return with_split(df, spec).groupBy("split", "year").agg(F.count(F.lit(1)).alias("rows"))


def select_window(
    metrics: DataFrame,
    spec: PanelSpec,
    min_valid_rows: int = 200,
    min_class_rows: int = 20,
    meetings: DataFrame | None = None,
    min_meetings: int = 100,
) -> DataFrame:
    """Candidate windows with their evidence; the first sufficient one is selected.

    The panel is reduced to one row per year before the windows are formed.
    """
    valid = (F.col("students") >= 0) & (F.col("w") >= 0)
    per_year = metrics.groupBy("year").agg(
        F.count_if(valid).alias("valid_rows"),
        F.count_if(valid & (F.col("w") > 0)).alias("positive_rows"),
        F.count_if(valid & (F.col("w") == 0)).alias("negative_rows"),
    )
    starts = F.array(*[F.lit(w[0]) for w in spec.windows()])
    in_windows = per_year.withColumn(
        "window_start",
        F.explode(F.filter(starts, lambda s: (F.col("year") >= s) & (F.col("year") <= s + 2))),
    )
    in_train = F.col("year") < F.col("window_start") + 2
    evidence = in_windows.groupBy("window_start").agg(
        F.count(F.lit(1)).alias("years_present"),
        F.sum("valid_rows").alias("valid_rows"),
        F.sum(F.when(in_train, F.col("positive_rows")).otherwise(0)).alias("train_positive_rows"),
        F.sum(F.when(in_train, F.col("negative_rows")).otherwise(0)).alias("train_negative_rows"),
    )
    enough = (
        (F.col("years_present") == 3)
        & (F.col("valid_rows") >= min_valid_rows)
        & (F.col("train_positive_rows") >= min_class_rows)
        & (F.col("train_negative_rows") >= min_class_rows)
    )
    if meetings is not None:
        enough = enough & F.lit(not meetings.limit(min_meetings).count() < min_meetings)
    marked = evidence.withColumn("sufficient", enough)
    # One row per candidate window: their number is fixed by the spec.
    best = marked.agg(F.min(F.when(F.col("sufficient"), F.col("window_start"))).alias("_best"))
    joined = marked.join(best, F.col("window_start") == F.col("_best"), "left")
    return joined.select(
        F.col("window_start").cast("long").alias("window_start"), "years_present", "valid_rows",
        "train_positive_rows", "train_negative_rows", "sufficient",
        F.col("_best").isNotNull().alias("selected"),
    )
