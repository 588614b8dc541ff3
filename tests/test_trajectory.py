import pytest
from pyspark.sql import functions as F

from helpers import grade_frame, records, six_year_rows
from termgrid.operators import backtest as B, continuity as C, eda as E, lags as L, stable as S
from termgrid.spec import TrajectorySpec


def panel(spark, rows):
    titles = S.title_rows(grade_frame(spark, rows))
    return titles, S.stable_terms(titles)


def row(df, **where):
    return [r for r in records(df) if all(r[k] == v for k, v in where.items())][0]


def test_lags_of_an_ordinary_course(spark):
    _, metrics = panel(spark, six_year_rows())
    lagged = L.with_lags(metrics)
    last = row(lagged, year=2024, term="spring")
    assert (last["lag1_w_flag"], last["lag2_w_flag"], last["lag3_w_flag"]) == (1, 0, 1)
    assert last["history_year_count"] == 3 and last["eligible_target"] and last["term_match_mode"] == "any_term"
    assert last["lag1_demand_proxy"] == 2 * (14 + 1) and last["lag1_grade_point_mean"] == 3.5
    assert not any(r["eligible_target"] for r in records(lagged) if r["year"] == 2019)


def test_history_crosses_terms_for_two_term_courses_only(spark):
    rows = [{**r, "W": 3 if (r["Year"], r["Term"]) == (2023, "Fall") else 0} for r in six_year_rows()]
    _, metrics = panel(spark, rows)
    assert row(L.with_lags(metrics), year=2024, term="spring")["lag1_w_flag"] == 1
    gap = [r for r in rows if r["Term"] == "Spring" and r["Year"] != 2023]
    _, one_term = panel(spark, gap)
    last = row(L.with_lags(one_term), year=2024)
    assert last["term_match_mode"] == "same_term" and last["lag1_w_flag"] is None and not last["eligible_target"]


def test_special_topics_are_set_aside(spark):
    base = six_year_rows()
    extra = {**base[-1], "Course Title": "Selected Topics", "Students": 999, "W": 9}
    titles, metrics = panel(spark, base + [extra, {**extra, "Subject": "MATH", "Number": 201}])
    assert row(metrics, year=2024, term="fall")["students"] == 15
    counts = records(S.special_key_counts(titles))[0]
    assert list(counts.values()) == [2, 1, 1]
    audit = S.special_topic_audit(titles)
    assert {r["title"] for r in records(audit)} == {"Selected Topics"} and audit.count() == 2
    changes = {r["counter"]: r["value"] for r in records(S.title_change_counts(titles))}
    assert changes["collision_base_key_count"] == 0


def test_title_edits_do_not_split_courses(spark):
    base = six_year_rows()
    light = [{**r, "Course Title": " intro!  "} if r["Year"] == 2023 else r for r in base]
    titles, metrics = panel(spark, light)
    assert row(L.with_lags(metrics), year=2024, term="spring")["lag1_w_flag"] is not None
    changes = {r["counter"]: r["value"] for r in records(S.title_change_counts(titles))}
    assert changes["multi_title_base_count"] == 0 and changes["cross_year_title_change_base_key_count"] == 0
    renamed = base + [{**base[-1], "Course Title": "Introductory Course"}]
    titles, metrics = panel(spark, renamed)
    audit = records(S.title_audit(titles))[0]
    assert audit["title_count"] == 2 and audit["title_changed"]
    assert row(metrics, year=2024, term="fall")["title"] == "Intro"  # tie: smallest text
    changes = {r["counter"]: r["value"] for r in records(S.title_change_counts(titles))}
    assert changes["collision_course_term_count"] == 1 and changes["cross_year_title_change_base_key_count"] == 1


def test_all_null_sums_stay_null(spark):
    _, metrics = panel(spark, [{**six_year_rows()[0], "Students": "x", "W": None}])
    only = records(metrics)[0]
    assert only["students"] is None and only["demand_proxy"] is None and only["w_flag"] == 0


def test_continuity_classes(spark):
    full = six_year_rows()
    spring = [{**r, "Subject": "MATH"} for r in full if r["Term"] == "Spring"]
    patchy = [{**r, "Subject": "STAT"} for r in full if r["Term"] == "Fall" and r["Year"] in (2019, 2020, 2022)]
    _, metrics = panel(spark, full + spring + patchy)
    by_subject = {r["subject"]: r for r in records(C.course_continuity(metrics))}
    assert by_subject["CS"]["continuity_class"] == "continuous_both_terms"
    assert by_subject["MATH"]["continuity_class"] == "seasonal_spring" and by_subject["MATH"]["period_coverage"] == 0.5
    stat = by_subject["STAT"]
    assert stat["continuity_class"] == "intermittent" and not stat["backtest_eligible"] and stat["excluded_reason"]
    assert stat["max_consecutive_fall_years"] == 2 and stat["observed_periods"] == "2019 fall | 2020 fall | 2022 fall"
    shares = {r["continuity_class"]: r["share"] for r in records(C.distribution(C.course_continuity(metrics), "continuity_class"))}
    assert shares["intermittent"] == pytest.approx(1 / 3)


def test_instructors_and_reconciliation(spark):
    base = six_year_rows()
    raw = grade_frame(spark, base + [{**base[0], "Primary Instructor": "second"}, {**base[0], "Primary Instructor": " A "}])
    audit = row(S.instructor_audit(raw), year=2019, term="spring")
    # Distinct raw names are counted, trimmed names are listed.
    assert (audit["instructor_count"], audit["instructors_observed"], audit["source_rows"]) == (3, "A | second", 3)
    source = S.raw_scope(raw)
    titles = S.title_rows(raw)
    metrics = S.stable_terms(titles)
    assert S.with_instructors(metrics, S.instructor_audit(raw)).count() == metrics.count()
    gaps = records(E.reconcile_periods(source, metrics))
    assert all(r["students_total_difference"] == 0 and r["w_total_difference"] == 0 for r in gaps)
    assert records(E.join_audit(source, metrics))[0]["source_groups_with_multiple_rows"] == 1
    fields = {r["field"]: r for r in records(E.numeric_summary(source))}
    assert fields["students"]["median"] == 12.0 and fields["a"]["non_null"] == 14
    inventory = records(E.table_inventory({"raw": raw.unionByName(raw.limit(1))}))[0]
    assert inventory["rows"] == 15 and inventory["duplicate_rows"] == 2
    odd = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, None)], "x string, y string")
    several = {r["table"]: r for r in records(E.table_inventory({"odd": odd, "once": odd.distinct(), "none": odd.limit(0)}))}
    assert [(several[n]["rows"], several[n]["duplicate_rows"], several[n]["missing_cells"]) for n in ("odd", "once", "none")] == [
        (4, 2, 5), (3, 0, 4), (0, 0, 0)]


def test_spec_rejects_other_scopes():
    with pytest.raises(ValueError):
        TrajectorySpec(source_years=(2021, 2022, 2023))
    with pytest.raises(ValueError):
        TrajectorySpec(terms=("spring",))


def many_courses(holdout=None):
    rows = []
    for n in range(12):
        for r in six_year_rows():
            new = {**r, "Number": 101 + n, "Subject": "CS" if n % 2 else "MATH", "W": (r["Year"] * (n + 1) + n) % 3 // 2}
            if holdout and r["Year"] == 2024:
                new.update(holdout)
            rows.append(new)
    return rows


def test_holdout_outcomes_never_reach_the_models(spark):
    runs = []
    for change in (None, {"W": 999, "Students": 1, "A": 777, "B": 888}):
        _, metrics = panel(spark, many_courses(change))
        runs.append(B.trajectory_backtest(L.with_lags(metrics), trees=5))
    key = ("term", "subject", "number", "model")
    scores = [
        {tuple(r[k] for k in key): r["predicted_probability"] for r in records(run.predictions) if r["year"] == 2024}
        for run in runs
    ]
    assert scores[0] == scores[1] and len(scores[0]) == 4 * 24
    assert runs[0].status == {"logistic_regression": "fit", "random_forest": "fit"}
    assert runs[0].predictions.groupBy("year", *key).count().where("count > 1").isEmpty()
    table = records(runs[0].coefficients)
    references = {r["reference_category"] for r in table if r["feature_type"] == "categorical"}
    assert references and all(r["odds_ratio"] > 0 for r in table)
    proof = records(runs[0].certificate)
    assert {r["feature"] for r in proof} == {r["feature"] for r in table} | {B.INTERCEPT}
    assert all(r["stationary"] for r in proof)
    short = B.logistic(proof[0]["rows"], max_iter=1)
    train = L.with_lags(metrics).where("eligible_target and split = 'train'")
    prep, ready, _, models = B._fit_models(
        train, B.TRAJECTORY_NUMERIC, "w_flag", {"drop_reference": True}, {"lr": lambda rows: short})
    assert not all(r["stationary"] for r in records(B.certificate_table(models["lr"], prep, ready)))
    assert {r["model"] for r in records(runs[0].metrics)} == {
        "constant_baseline", "persistence_baseline", "logistic_regression", "random_forest"}


def test_null_keys_stay_one_course(spark):
    rows = [{**r, "Subject": None} for r in six_year_rows()]
    _, metrics = panel(spark, rows)
    lagged = L.with_lags(metrics)
    assert row(lagged, year=2024, term="fall")["history_year_count"] == 3
    assert lagged.where(F.col("subject").isNull()).count() == 12


def test_entries_of_a_very_long_list(spark):
    from termgrid.operators import entries

    rows = spark.range(1_000_000).selectExpr("'a' AS k", "lpad(cast(id AS string), 7, '0') AS e").unionByName(
        spark.createDataFrame([("b", "y"), ("b", "x"), ("b", "x"), ("b", None), (None, "z")], "k string, e string"))
    found = entries.numbered_entries(rows, ["k"], "e")
    assert found.where("k = 'a'").selectExpr("count(*)", "min(ordinal)", "max(ordinal)", "sum(cast(ordinal = cast(e AS long) AS int))").first()[:] == (10**6, 0, 999_999, 10**6)
    assert sorted((r["k"] or "", r["ordinal"], r["e"]) for r in found.where("k is null or k = 'b'").collect()) == [("", 0, "z"), ("b", 0, "x"), ("b", 1, "y")]
    texts = entries.entry_texts(found, ["k"], "e")
    assert texts.where("k = 'a'").count() == 1000 and texts.where("k = 'b'").first()["text"] == "x | y"


def plan_of(spark, df):
    """The optimised plan with all its fields."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_lag_windows_are_worked_out_once(spark):
    """Per lag: a count, five sums, a flag and five fields per term; two more tell the terms of a course."""
    _, metrics = panel(spark, six_year_rows())
    assert plan_of(spark, L.with_lags(metrics)).count("windowspecdefinition(") == 3 * (1 + 5 + 1 + 2 * 5) + 2


def test_forest_keeps_the_node_of_a_row(spark):
    """Rows start a level at their node; the trees are those of rows that walk from the root."""
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([float(i % 7), float(i % 5), float(i * i % 11)]), float(i * i % 11 > i % 7), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, ["features", "label", "weight"]).repartition(3).persist()
    maker = B.forest(7, 5)
    assert maker.getCacheNodeIds()
    assert maker.fit(df).toDebugString.split("\n", 1)[1] == maker.setCacheNodeIds(False).fit(df).toDebugString.split("\n", 1)[1]


def test_inventory_writes_repeated_rows_only(spark, monkeypatch):
    written = []
    monkeypatch.setattr(E, "materialize", lambda df, name: written.append(df.persist()) or written[-1])
    df = spark.createDataFrame([(i, None) for i in range(50)] + [(7, None), (8, "x"), (8, "x")], "a int, b string")
    got = records(E.table_inventory({"t": df}))[0]
    assert (got["rows"], got["duplicate_rows"], got["missing_cells"]) == (53, 4, 51)
    assert written[0].count() == 3  # two repeated rows, and one line for all others


@pytest.mark.parametrize("name", ["eda_inventory", "audit_counts"])
def test_grade_rows_are_made_once(spark, monkeypatch, name):
    from termgrid.plans import catalog
    from termgrid.spec import BANDS

    calls = []
    schema = "year int, term string, year_term string, subject string, number string, title string, sched_type string, " + "".join(
        f"{b} double, " for b in BANDS) + "w double, students double, instructor string"
    rows = [(1995 + i % 6, "Spring", "x", "CS", str(i % 4), ("Special Topics: a", "Logic")[i % 3 > 0], "L", *[1.0] * len(BANDS),
             float(i % 2), 9.0, None if i % 5 == 0 else "A") for i in range(60)]

    def grade_rows(session, sf):
        calls.append(sf)
        return session.createDataFrame(rows, schema)

    monkeypatch.setattr(catalog, "grade_rows", grade_rows)
    got = records(catalog.queries()[name](spark, "none"))
    assert len(calls) == 1
    if name == "eda_inventory":
        assert {r["table"]: r["rows"] for r in got} == {"raw_input": 60, "six_year_source": 60, "six_year_analysis": 40, "course_term_metrics": 8}
    else:
        assert {r["counter"]: r["value"] for r in got}["instructor_missing_source_rows_in_scope"] == 12
