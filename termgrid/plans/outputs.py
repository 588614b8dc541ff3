"""The finished analyses: tables and reports of each, and one sink for all.

Each plan takes frames and returns lazy frames; shared intermediate tables are
materialised once.  ``write_outputs`` writes every table as CSV under the
source's own column names and every report as JSON.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgrid.functions.text import is_special_topic
from termgrid.operators import (
    backtest, conflicts, continuity, demand, eda, history, lags, normalize, profiles, quality, schedule, stable,
)
from termgrid.sources import documents, tables
from termgrid.sources.scratch import materialize
from termgrid.spec import (
    COURSE_KEY, HIGH_DEMAND_QUANTILE, HIGH_RISK_QUANTILE, MIN_DEMAND, STABLE_TERM_KEY, PanelSpec, TrajectorySpec,
)


@dataclass
class Outputs:
    tables: dict[str, DataFrame]
    reports: dict[str, DataFrame] = field(default_factory=dict)


def _facts(df: DataFrame, section: str, *keys: str) -> DataFrame:
    """Numbers of a small frame as report rows (section, key, value), keyed by its key columns."""
    numbers = [c for c in df.columns if c not in keys]
    wide = df.select(
        F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("_key"),
        *[F.col(c).cast("double").alias(c) for c in numbers],
    )
    long = wide.unpivot(["_key"], numbers, "_name", "value")
    key = F.concat_ws("|", F.when(F.col("_key") != "", F.col("_key")), F.col("_name"))
    return long.select(F.lit(section).alias("section"), key.alias("key"), "value")


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def normalized_outputs(raw: DataFrame, spec: PanelSpec | None = None) -> Outputs:
    """Filtered rows, course-term metrics, quality and validation reports."""
    spec = spec or PanelSpec()
    filtered = normalize.normalize_rows(raw, spec)
    metrics = materialize(normalize.course_term_metrics(filtered, spec), "metrics")
    checked = quality.validation(filtered, metrics, spec)
    return Outputs(
        {"filtered_rows": filtered, "course_term_metrics": metrics},
        {
            "quality_report": normalize.quality_report(raw, spec),
            "validation_report": checked.checks, "validation_summary": checked.summary,
        },
    )


def demand_outputs(
    metrics: DataFrame, spec: PanelSpec | None = None,
    quantile: float = HIGH_DEMAND_QUANTILE, min_demand: int = MIN_DEMAND,
) -> Outputs:
    """Ranked course-terms, ranked courses and the demand report."""
    spec = spec or PanelSpec()
    table = demand.demand_metrics(metrics, spec, quantile, min_demand)
    table.rows = materialize(table.rows, "ranked")
    summary = materialize(demand.course_summary(table.rows, min_demand), "summary")
    return Outputs(
        {
            "course_term_demand_metrics": demand.in_term_order(table.rows, spec.terms),
            "course_demand_summary": demand.in_rank_order(summary),
        },
        {"demand_report": demand.demand_report(table, summary)},
    )


def risk_outputs(
    metrics: DataFrame, spec: PanelSpec | None = None, quantile: float = HIGH_RISK_QUANTILE,
    trees: int = 250, restarts: int = 20, models=("logistic_regression", "random_forest"),
) -> Outputs:
    """Feature table, predictions, metrics, importances and course profiles."""
    table = history.feature_table(metrics, spec, quantile)
    run = backtest.risk_backtest(table, models, trees)
    found = profiles.course_profiles(table.rows, restarts=restarts)
    spark = metrics.sparkSession
    status = [(name, text) for name, text in run.status.items()] + [("profiles", found.reason or found.status)]
    feature_order = [F.col(c) for c in ("year", "term", *COURSE_KEY)]
    out = {
        "feature_table": table.rows.orderBy(*feature_order),
        "model_metrics": run.metrics,
        "predictions": run.predictions.orderBy("model", *feature_order),
    }
    if run.importance is not None:
        out["feature_importance"] = run.importance.orderBy("model", F.col("importance").desc(), "feature")
    if found.rows is not None:
        out["course_profiles"] = found.rows.orderBy("cluster", *COURSE_KEY)
    report = _stack([
        _facts(history.label_counts(table.rows).drop("class_status"), "label", "split"),
        _facts(history.history_coverage(table.rows), "history_coverage", "split", "measure"),
        _facts(spark.createDataFrame([(table.label.threshold,)], "threshold double"), "label"),
    ])
    return Outputs(out, {"risk_report": report, "fit_status": spark.createDataFrame(status, "model string, status string")})


def trajectory_outputs(
    raw: DataFrame, years: TrajectorySpec | None = None, panel: PanelSpec | None = None,
    trees: int = 300, models=("logistic_regression", "random_forest"),
) -> Outputs:
    """The six-year backtest with its audits, continuity table and exploratory tables."""
    years, panel = years or TrajectorySpec(), panel or PanelSpec()
    titles = materialize(stable.title_rows(raw, years, panel), "titles")
    instructors = materialize(stable.instructor_audit(raw, years, panel), "instructors")
    metrics = materialize(stable.with_instructors(stable.stable_terms(titles), instructors), "stable")
    lagged = materialize(lags.with_lags(metrics, years), "lagged")
    seen = materialize(continuity.course_continuity(metrics, years), "continuity")
    run = backtest.trajectory_backtest(lagged, models, trees)
    source = stable.raw_scope(raw, years, panel)
    ordinary = source
    if "title" in source.columns:
        ordinary = source.where(~is_special_topic(F.col("title")))
    special = stable.special_topic_audit(titles)
    periods = materialize(eda.reconcile_periods(ordinary, metrics), "periods")
    out = {
        "trajectory": lagged, "predictions": run.predictions, "metrics": run.metrics,
        "title_audit": stable.title_audit(titles), "continuity": seen,
        "special_topic_audit": special, "instructor_audit": instructors,
        "eda_inventory": eda.table_inventory({
            "raw_input": panel.canonical(raw), "six_year_spring_fall_source": source,
            "six_year_spring_fall_analysis": ordinary, "course_term_metrics": metrics,
        }),
        "eda_coverage": periods,
        "eda_subject_distribution": eda.subject_distribution(ordinary),
        "eda_numeric_summary": eda.numeric_summary(ordinary),
        "eda_join_audit": eda.join_audit(ordinary, metrics),
    }
    if run.coefficients is not None:
        out["logistic_coefficients"] = run.coefficients
    sizes = metrics.sparkSession.range(1)
    report = _stack([
        _facts(stable.scope_counts(raw, titles, metrics), "scope", "counter"),
        _facts(stable.audit_counts(raw, titles, metrics, periods, years, panel), "audits", "counter"),
        _facts(stable.title_change_counts(titles, years), "titles", "counter"),
        _facts(stable.special_key_counts(titles), "special_topics"),
        _facts(lags.target_coverage(lagged, years), "coverage_by_target_year_term", "year", "term"),
        _facts(lags.annual_w(lagged), "w_year_term_summary", "year", "term"),
        _facts(continuity.distribution(seen, "continuity_class"), "continuity_class_counts", "continuity_class"),
        _facts(continuity.distribution(seen, "observed_period_count"), "observed_period_distribution", "observed_period_count"),
        _facts(continuity.distribution(seen, "primary_observed_year_count"), "primary_year_distribution", "primary_observed_year_count"),
        _facts(seen.agg(F.count_if("backtest_eligible").alias("backtest_eligible_course_count"),
                        F.count_if(~F.col("backtest_eligible")).alias("excluded_course_count")), "continuity"),
        _facts(sizes.select(F.lit(len(years.source_years)).alias("source_years"), F.lit(years.holdout_year).alias("holdout_year"),
                            F.lit(years.min_history_years).alias("minimum_history_years")), "parameters"),
    ])
    fit_status = metrics.sparkSession.createDataFrame(list(run.status.items()), "model string, status string")
    return Outputs(out, {"trajectory_report": report, "fit_status": fit_status})


def timetable_outputs(docs: DataFrame, records: DataFrame) -> Outputs:
    """Six normalised tables, quality rows and conflict edges from stored documents."""
    read = documents.parsed_tables(docs)
    parsed = {name: materialize(df, name) for name, df in documents.tables_of(*read).items()}
    evidence = schedule.quality_rows(records, {k: v for k, v in parsed.items() if k != "courses"}, read)
    edges = materialize(conflicts.conflict_edges(parsed["sections"], parsed["meetings"]), "edges")
    return Outputs(
        {**parsed, "quality_report": evidence, "conflict_edges": edges},
        {"schedule_gate": schedule.schedule_gate(evidence, edges)},
    )


def write_outputs(outputs: Outputs, folder: str, spec: PanelSpec | None = None) -> dict[str, str]:
    """Write each table to ``folder/<name>`` as CSV and each report as JSON."""
    spec = spec or PanelSpec()
    folder = folder.rstrip("/")
    paths = {}
    for name, df in outputs.tables.items():
        paths[name] = f"{folder}/{name}"
        panel = set(STABLE_TERM_KEY) & set(df.columns) and "section_id" not in df.columns
        tables.write_csv(spec.published(df) if panel else df, paths[name])
    for name, df in outputs.reports.items():
        paths[name] = f"{folder}/{name}"
        tables.write_report(df, paths[name])
    return paths
