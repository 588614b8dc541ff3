import pytest
from pyspark.sql import functions as F

from helpers import grade_frame, records
from termgrid.functions import numbers as num
from termgrid.operators import normalize as N
from termgrid.spec import PanelSpec, check_terms, check_window


def test_window_and_term_filters(spark):
    rows = [{"Year": y} for y in range(2020, 2025)] + [{"Term": t} for t in (" Spring", "FALL", "summer", "winter")]
    out = N.normalize_rows(grade_frame(spark, rows))
    assert {r["year"] for r in records(out)} == {2021, 2022, 2023}
    assert {r["term"] for r in records(out)} == {"spring", "fall"}


def test_missing_column_and_parameters_raise(spark):
    with pytest.raises(ValueError):
        N.normalize_rows(grade_frame(spark, [{}]).drop("Students"))
    for window in ([2021, 2022, 2023], (2021, 2022), (2021, 2022, True), (2021, 2023, 2024), (2019, 2020, 2021)):
        with pytest.raises((TypeError, ValueError)):
            check_window(window)
    for terms in (["spring"], (), ("summer",), ("spring", "Spring"), (1,)):
        with pytest.raises((TypeError, ValueError)):
            check_terms(terms)


def test_metrics_formulas_and_null_rules(spark):
    rows = [
        {"Primary Instructor": "A", "A": 3, "Students": 10, "W": 5},
        {"Primary Instructor": "B", "A": 1, "B": 4, "Students": 5},
        {"Number": "102", "A": "not-a-number", "Students": "bad", "W": None},
    ]
    filtered = N.normalize_rows(grade_frame(spark, rows))
    bad = [r for r in records(filtered) if r["number"] == "102"][0]
    assert bad["a"] is None and bad["students"] is None
    first, second = records(N.course_term_metrics(filtered), "number")
    assert (first["students"], first["a"], first["w_proxy"]) == (15, 4, 5 / 20)
    assert first["share_a"] == 0.5 and first["grade_point_mean"] == 3.5
    # A group without any value sums to 0; its ratios are null.
    assert second["students"] == 0 and second["w"] == 0 and second["w_proxy"] is None


def test_number_text(spark):
    texts = ["12", " 1.5 ", "-3", ".5", "1e2", "1d", "0x10", "nan", "inf", "", None, "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["v"] for r in df.select("i", num.parse_number(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [12.0, 1.5, -3.0, 0.5, 100.0, None, None, None, float("inf"), None, None, None]


def test_course_level(spark):
    df = spark.createDataFrame([("101",), ("99",), ("1250",), ("-5",), ("10A",), (None,), ("inf",)], "n string")
    rows = df.select(num.course_level(F.col("n")).alias("h"), num.course_level(F.col("n"), True).alias("t")).collect()
    assert [r["h"] for r in rows] == [100, 0, 900, None, None, None, None]
    assert [r["t"] for r in rows] == [100, 0, 900, 0, None, None, None]


def test_present_share_column_wins(spark):
    df = spark.createDataFrame([(4.0, 6.0, 0.9)], "a double, b double, share_a double")
    row = records(N.with_derived_shares(df))[0]
    assert (row["share_a"], row["share_b"], row["share_c"], row["grade_total"]) == (0.9, 0.6, None, 10.0)


def test_quality_report_counts(spark):
    raw = grade_frame(spark, [{}, {}, {"Number": "7", "W": "bad"}, {"Year": 2019, "W": "bad"}])
    report = {(r["section"], r["field"]): r["value"] for r in records(N.quality_report(raw))}
    assert report[("rows", "raw_rows")] == 4 and report[("rows", "filtered_rows")] == 3
    assert report[("rows", "duplicate_rows")] == 2
    filtered = N.normalize_rows(raw)
    assert report[("rows", "course_term_rows")] == N.course_term_metrics(filtered).count()
    assert {f for section, f in report if section == "filtered_missing"} == set(filtered.columns)
    empty = {(r["section"], r["field"]): r["value"] for r in records(N.quality_report(raw.limit(0)))}
    assert set(empty) == set(report) and not any(empty.values())
    assert report[("raw_non_numeric_in_scope", "w")] == 1 and report[("filtered_missing", "w")] == 1


def test_published_names_round_trip(spark):
    spec = PanelSpec()
    metrics = N.course_term_metrics(N.normalize_rows(grade_frame(spark, [{}])))
    out = spec.published(metrics)
    assert {"Course Title", "A+", "share_A+", "W_proxy"} <= set(out.columns)
