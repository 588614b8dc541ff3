import pytest

from helpers import metrics_frame, records
from termgrid.operators import demand as D, quality as Q
from termgrid.operators.normalize import course_term_metrics, normalize_rows
from termgrid.spec import PanelSpec
from helpers import grade_frame


def test_demand_needs_both_counts(spark):
    df = metrics_frame(spark, [{"students": 15.0, "w": 5.0}, {"number": "102", "students": None}, {"number": "103", "students": -1.0}])
    table = D.demand_metrics(df, min_demand=1)
    first, second, third = records(table.rows, "number")
    assert (first["demand_proxy"], first["w_proxy"], first["demand_rank"], first["w_proxy_rank"]) == (20, 0.25, 1, 1)
    assert second["demand_proxy"] is None and second["w_proxy"] is None and second["demand_rank"] is None
    assert third["demand_proxy"] is None and not third["is_high_demand"]
    assert records(D.demand_quality(table.rows))[0]["rows_with_missing_or_negative_counts"] == 2


def test_threshold_and_flag(spark):
    df = metrics_frame(spark, [{"number": f"00{i}", "students": 10.0 * i} for i in range(1, 5)])
    table = D.demand_metrics(df, min_demand=1)
    assert table.threshold == 32.5
    assert sum(r["is_high_demand"] for r in records(table.rows)) == 1


def test_scope_and_duplicates(spark):
    df = metrics_frame(spark, [{"year": 2020}, {"year": 2021, "term": "fall"}, {"year": 2022, "term": "summer"}])
    assert [(r["year"], r["term"]) for r in records(D.demand_metrics(df).rows)] == [(2021, "fall")]
    with pytest.raises(ValueError, match="unique course-term"):
        D.demand_metrics(metrics_frame(spark, [{}, {}]))
    with pytest.raises(ValueError):
        D.demand_metrics(metrics_frame(spark, [{"students": None}]))
    with pytest.raises(TypeError):
        D.demand_metrics(df, min_demand=True)


def test_summary_totals_and_ranks(spark):
    df = metrics_frame(spark, [
        {"year": 2021, "students": 10.0}, {"year": 2022, "students": 20.0, "w": 5.0},
        {"number": "102", "students": 35.0}, {"number": "103", "students": None},
    ])
    summary = D.course_summary(D.demand_metrics(df, min_demand=1).rows, min_demand=1)
    first, second, third = records(summary, "number")
    assert (first["demand_proxy_total"], first["students_total"], first["w_total"]) == (35, 30, 5)
    assert first["w_proxy_weighted"] == pytest.approx(5 / 35) and first["course_term_count"] == 2
    assert first["years_observed"] == "2021,2022"
    assert first["demand_total_rank"] == second["demand_total_rank"] == 1
    assert third["demand_total_rank"] is None and third["high_demand_share"] is None
    with pytest.raises(ValueError, match="missing required columns"):
        D.course_summary(df.select("subject"))


def test_orders_and_top_lists(spark):
    df = metrics_frame(spark, [
        {"term": "fall", "students": 10.0, "w": 10.0}, {"term": "spring", "students": 30.0, "w": 30.0}, {"number": "9", "students": 50.0},
    ])
    table = D.demand_metrics(df)
    assert [r["term"] for r in D.in_term_order(table.rows, ("spring", "fall")).collect()][-1] == "fall"
    assert [r["demand_proxy"] for r in D.top_by_demand(table.rows, 2).collect()] == [60, 50]
    # Equal shares: the smaller demand comes first.
    assert [r["demand_proxy"] for r in D.top_by_share(table.rows, 2).collect()] == [20, 60]
    report = records(D.demand_report(table, D.course_summary(table.rows)))
    assert {r["section"] for r in report} >= {"row_counts", "ranking_parameters", "top_courses_by_total_demand"}


def test_validation_report_never_raises(spark):
    filtered = normalize_rows(grade_frame(spark, [{"Year": y} for y in (2021, 2022, 2023)]))
    metrics = course_term_metrics(filtered)
    assert all(r["passed"] for r in records(Q.validate_tables(filtered, metrics)))
    broken = {r["check"]: r["passed"] for r in records(Q.validate_tables(filtered, metrics.where("year < 2023").drop("share_a")))}
    assert not broken["column_sums_match"] and not broken["split_by_window"] and not broken["metrics_has_required_columns"]
    empty = {r["check"]: r["passed"] for r in records(Q.validate_tables(filtered, metrics.select("subject")))}
    assert not empty["metrics_year_in_window"] and empty["filtered_year_in_window"]
    good = records(Q.validation(filtered, metrics).summary)[0]
    assert good["passed"] and good["errors"] == "" and good["filtered_rows"] == filtered.count()
    assert good["train_rows"] + good["holdout_rows"] == good["metrics_rows"] == metrics.count()
    doubled = records(Q.validation(filtered, metrics.unionByName(metrics)).summary)[0]
    assert not doubled["passed"] and doubled["errors"] == "metrics_group_keys_unique;column_sums_match"
    late = records(Q.validation(filtered, metrics.where("year < 2023")).summary)[0]
    assert not late["passed"] and late["train_rows"] == late["holdout_rows"] == 0


def test_split_and_contract(spark):
    spec = PanelSpec()
    df = metrics_frame(spark, [{"year": y} for y in (2021, 2022, 2023)])
    train, holdout = Q.split_by_window(df, spec)
    assert (train.count(), holdout.count()) == (2, 1)
    for bad in (df.where("year < 2023"), df.limit(0), metrics_frame(spark, [{"year": 2024}])):
        with pytest.raises(ValueError):
            Q.split_by_window(bad, spec)
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, r int")
    assert {(r["k"], r["r"]) for r in records(Q.join_with_contract(left, right, ["k"]))} == {(None, 10), ("a", None)}
    with pytest.raises(ValueError):
        Q.join_with_contract(left, right.unionByName(right), ["k"])
