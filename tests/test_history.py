import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from helpers import metrics_frame, records
from termgrid.operators import backtest as B, demand as D, history as H, profiles as P
from termgrid.operators.normalize import with_derived_shares


def frame(spark, copies=1, holdout_w=1.0):
    rows = []
    for year in (2021, 2022, 2023):
        for i, number in enumerate(("100", "200", "300", "400")):
            for c in range(copies):
                w = holdout_w if year == 2023 else float((i + year + c) % 3)
                rows.append({"year": year, "term": "spring" if i % 2 else "fall", "number": number,
                             "subject": f"S{c}", "students": 20.0 + i, "w": w})
    return D.with_demand(with_derived_shares(metrics_frame(spark, rows)))


def test_threshold_uses_train_rows_only(spark):
    low, high = (H.feature_table(frame(spark, holdout_w=w)) for w in (1.0, 500.0))
    assert low.label.threshold == high.label.threshold
    assert {r["split"] for r in records(H.label_counts(low.rows))} == {"train", "holdout"}


def test_history_is_strictly_prior(spark):
    rows = {(r["year"], r["number"]): r for r in records(H.feature_table(frame(spark)).rows)}
    assert rows[(2021, "100")]["historical_w_proxy_mean"] is None
    assert rows[(2023, "100")]["historical_term_count"] == 2
    want = (rows[(2021, "100")]["w_proxy"] + rows[(2022, "100")]["w_proxy"]) / 2
    assert rows[(2023, "100")]["historical_w_proxy_mean"] == pytest.approx(want)


def test_history_averages_years_not_rows(spark):
    df = metrics_frame(spark, [
        {"year": 2021, "term": "spring", "w": 10.0}, {"year": 2021, "term": "fall", "w": 30.0, "students": 10.0},
        {"year": 2022, "w": 0.0, "students": 40.0}, {"year": 2023},
    ])
    rows = {(r["year"], r["term"]): r for r in records(H.with_history(D.with_demand(with_derived_shares(df))))}
    assert rows[(2023, "spring")]["historical_demand_proxy_mean"] == pytest.approx((30 + 40) / 2)
    assert rows[(2023, "spring")]["historical_term_count"] == 3


def test_strict_rule_when_all_rows_would_be_labelled(spark):
    df = spark.createDataFrame([("train", 0.0)] * 5 + [("holdout", 0.2)], "split string, w_proxy double")
    label = H.risk_label(df)
    assert label.strict and label.operator == ">"
    assert [r["y"] for r in df.select(label.column().alias("y")).collect()] == [0] * 5 + [1]


def test_leak_guard(spark):
    numeric, categorical = H.model_features(H.feature_table(frame(spark)).rows)
    assert not H.LEAKAGE_COLUMNS & set(numeric + categorical)
    assert "historical_share_a" not in numeric  # no value anywhere


def test_risk_backtest_and_one_class_skip(spark):
    table = H.feature_table(frame(spark, copies=4))
    run = B.risk_backtest(table, ("logistic_regression",))
    assert run.status == {"logistic_regression": "fit"}
    assert run.predictions.groupBy("row_id", "model").count().where("count > 1").isEmpty()
    constant = frame(spark).withColumn("w_proxy", F.lit(0.1))
    skipped = B.risk_backtest(H.feature_table(constant), ("logistic_regression",))
    assert skipped.status["logistic_regression"] == "skipped_one_class_training_target"
    assert {r["model"] for r in records(skipped.metrics)} == {"majority_baseline"}


def test_profiles_and_skip_reasons(spark):
    assert P.course_profiles(H.feature_table(frame(spark)).rows).reason == "too_few_train_courses"
    found = P.course_profiles(H.feature_table(frame(spark, copies=5)).rows, restarts=2)
    assert found.status == "ok" and 2 <= found.best_k <= 5
    assert found.rows.count() == 20
    assert sum(r["course_count"] for r in records(P.cluster_sizes(found.rows))) == 20


def test_fits_improved_together_are_those_of_spark(spark):
    rows = spark.range(0, 600, 1, 3).selectExpr("cast(id % 3 as double) * 2 + rand(1) as a", "rand(2) + cast(id % 2 as double) * 3 as b")
    points = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).persist()
    start = lambda k, **limit: KMeans(k=k, seed=k, **limit).fit(points)
    steps = []
    moved = P._moved
    P._moved = lambda points, centers: steps.append(len(centers)) or moved(points, centers)
    try:
        fits = P.improved_together(points, [np.array(start(k, maxIter=0).clusterCenters()) for k in (2, 4)])
    finally:
        P._moved = moved
    assert steps[0] == 2 and steps == sorted(steps, reverse=True)
    for k, fit in zip((2, 4), fits):
        whole = start(k, maxIter=300)
        assert np.allclose(fit.centers, whole.clusterCenters()) and fit.cost == pytest.approx(whole.summary.trainingCost)
        sizes = {r["cluster"]: r["count"] for r in records(P.with_cluster(points, fit.centers).groupBy("cluster").count())}
        assert sizes == dict(enumerate(whole.summary.clusterSizes))
    points.unpersist()


def test_history_windows_of_a_year_are_one_operator(spark):
    """One window over a year, one over the earlier years; repeated and null terms count as a set of terms does."""
    df = metrics_frame(spark, [
        {"year": 2021, "term": "fall"}, {"year": 2021, "term": "spring"}, {"year": 2021, "term": "spring"},
        {"year": 2022, "term": None}, {"year": 2023},
    ])
    history = H.with_history(D.with_demand(with_derived_shares(df)))
    assert history._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
    counts = {r["year"]: r["historical_term_count"] for r in records(history)}
    assert counts == {2021: None, 2022: 2.0, 2023: 2.0}


def test_fits_start_together(spark):
    """The passes over the points don't grow with the fits, and the starts don't hang on how the points lie."""
    rows = spark.range(0, 3000).selectExpr("id", "cast(id % 3 as double) * 9 + rand(1) as a", "cast(id % 3 as double) * 9 + rand(2) as b")
    points = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).persist()
    jobs, starts = [], []
    for parts, sizes in ((3, [3] * 2), (5, [3] * 2 + [4] * 10)):
        kept = P.packed(points.repartition(parts), ["id"]).persist()
        spark.sparkContext.setJobGroup(f"starts-{parts}", "")
        starts.append(P.started_together(kept, sizes, 7))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"starts-{parts}")))
        kept.unpersist()
    assert abs(jobs[1] - jobs[0]) <= 3  # six passes either way, with the jobs that Spark makes of their shuffles
    assert [len(c) for c in starts[1]] == [3] * 2 + [4] * 10
    for one, other in zip(*starts):
        assert np.allclose(one, other)
        assert sorted(round((c - 0.5) / 9) for c in one[:, 0]) == [0, 1, 2]  # one start in each of the three groups
    few = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame([(1.0,), (2.0,), (2.0,)], ["a"]))
    assert all(len(c) <= 2 for c in P.started_together(P.packed(few), [5, 5], 1)) and P.started_together(P.packed(few), [], 1) == []
    points.unpersist()


def test_many_courses_start_together(spark, monkeypatch):
    rows = H.feature_table(frame(spark, copies=5)).rows
    few = P.course_profiles(rows, restarts=8)
    monkeypatch.setattr(P, "STARTS_APART", 0)
    monkeypatch.setattr(P, "KMeans", None)
    many = P.course_profiles(rows, restarts=8)
    assert (many.status, many.best_k) == ("ok", few.best_k) and many.silhouette == pytest.approx(few.silhouette, abs=0.05)
    assert many.rows.count() == 20
