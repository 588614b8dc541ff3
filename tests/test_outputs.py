from helpers import grade_frame, records
from test_schedule import COURSE
from test_trajectory import many_courses
from termgrid.operators import demand
from termgrid.plans import outputs as P
from termgrid.spec import PanelSpec


def test_panel_plans_end_to_end(spark, tmp_path):
    raw = grade_frame(spark, many_courses())
    spec = PanelSpec()
    normal = P.normalized_outputs(raw, spec)
    assert all(r["passed"] for r in records(normal.reports["validation_report"]))
    metrics = normal.tables["course_term_metrics"]
    ranked = P.demand_outputs(metrics, spec)
    assert ranked.tables["course_term_demand_metrics"].count() == metrics.count() == 72
    paths = P.write_outputs(ranked, str(tmp_path / "demand"), spec)
    again = spark.read.option("header", True).csv(paths["course_term_demand_metrics"])
    assert {"Year", "Course Title", "A+", "share_A+", "W_proxy", "demand_rank"} <= set(again.columns)
    assert spark.read.json(paths["demand_report"]).count() > 10
    risk = P.risk_outputs(demand.with_demand(metrics), spec, restarts=1, models=("logistic_regression",))
    assert risk.tables["feature_table"].count() == 72
    assert {r["model"] for r in records(risk.reports["fit_status"])} == {"logistic_regression", "profiles"}


def test_trajectory_plan(spark, tmp_path):
    out = P.trajectory_outputs(grade_frame(spark, many_courses()), models=("logistic_regression",))
    paths = P.write_outputs(out, str(tmp_path / "trajectory"))
    assert len(paths) == 15
    report = {(r["section"], r["key"]): r["value"] for r in records(out.reports["trajectory_report"])}
    assert report[("scope", "course_term_rows|value")] == 144
    assert report[("coverage_by_target_year_term", "2024|fall|eligible_rows")] == 12
    assert report[("continuity_class_counts", "continuous_both_terms|share")] == 1.0
    rows = spark.read.option("header", True).csv(paths["predictions"])
    assert {"Subject", "Number", "predicted_probability", "instructors_observed"} <= set(rows.columns)


def test_timetable_plan(spark, tmp_path):
    docs = spark.createDataFrame([("2023-fall", "a", COURSE)], "term string, doc_order string, xml string")
    fetched = spark.createDataFrame(
        [("2023-fall", "CS", "ok", "200", "h")], "term string, subject string, status string, http_status string, sha256 string")
    out = P.timetable_outputs(docs, fetched)
    assert records(out.reports["schedule_gate"])[0]["verified"]
    paths = P.write_outputs(out, str(tmp_path / "timetable"))
    meetings = spark.read.option("header", True).csv(paths["meetings"])
    assert {r["weekdays"] for r in records(meetings)} >= {"MON|WED|FRI"}
