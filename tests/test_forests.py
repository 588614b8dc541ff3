import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from termgrid.operators import backtest as B, forests as R, ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    drawn = spark.range(0, 4000, 1, 3).select("id", *[F.rand(i).alias(f"x{i}") for i in range(4)], (F.rand(8) < 0.3).cast("double").alias("x4"), F.rand(9).alias("u"))
    high = F.col("u") < F.when((F.col("x0") > 0.5) == (F.col("x1") > 0.3), 0.9).otherwise(0.15) * (0.5 + F.col("x4") / 2)
    out = drawn.select("id", array_to_vector(F.array(*[f"x{i}" for i in range(5)], F.lit(1.0))).alias("features"), high.cast("double").alias("label"))
    return out.withColumn("weight", F.when(F.col("label") == 1, 1.4).otherwise(0.8)).persist()


def test_forest_for_many_rows_is_as_good(spark, rows):
    train, rest = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    assert isinstance(B.forest_for(B.FOREST_ROWS + 1, 5), R.HistogramForest) and not isinstance(B.forest_for(B.FOREST_ROWS, 5), R.HistogramForest)
    ours, theirs = R.HistogramForest(30, 8, 3, 42).fit(train), B.forest(30, 8).fit(train)
    measure = BinaryClassificationEvaluator(rawPredictionCol="probability")
    good = measure.evaluate(theirs.transform(rest))
    assert good > 0.8 and abs(measure.evaluate(ours.transform(rest)) - good) < 0.03
    assert np.allclose(ours.importances, theirs.featureImportances.toArray(), atol=0.06) and ours.importances.sum() == pytest.approx(1)
    assert abs(sum(len(t.left) for t in ours.trees) / theirs.totalNumNodes - 1) < 0.2
    again = R.HistogramForest(30, 8, 3, 42).fit(train)
    assert all((a.counts == b.counts).all() and (a.cut == b.cut).all() for a, b in zip(ours.trees, again.trees))


def test_forest_trees_hold_what_reaches_them(spark, rows):
    """Bootstrap counts of a node are those of its children, no leaf is too small, and scores are the leaves' weighted shares."""
    model = R.HistogramForest(6, 30, 3, 1).fit(rows)
    for t in model.trees:
        inner = np.flatnonzero(t.left != np.arange(len(t.left)))
        assert (t.counts[inner] == t.counts[t.left[inner]] + t.counts[t.left[inner] + 1]).all()
        assert t.counts.sum(1).min() >= 3 and t.counts[0].sum() == pytest.approx(4000, rel=0.1)
        assert t.depth > 8 and len(inner) * 2 + 1 == len(t.left)
    kept = rows.select(vector_to_array("features").alias("x")).limit(20).persist()
    got = [r["p"] for r in model.transform(kept.select(array_to_vector("x").alias("features"))).select(vector_to_array("probability")[1].alias("p")).collect()]
    for r, p in zip(kept.collect(), got):
        shares = []
        for t in model.trees:
            node = 0
            while t.left[node] != node:
                f = t.feature[node]
                node = t.left[node] + int(r["x"][f] > np.append(model.borders[f], np.inf)[t.cut[node]])
            shares.append((t.counts[node] * model.weights)[1] / (t.counts[node] * model.weights).sum())
        assert p == pytest.approx(np.mean(shares))


def test_bounds_below(spark):
    for bounds in (1, 2, 5, 16, 100, 257):
        column = O._bounds_below(F.col("id").cast("double"), "double", [F.lit(3 * i) for i in range(bounds)])
        got = [r["n"] for r in spark.range(0, 3 * bounds + 5).select(column.alias("n")).collect()]
        assert got == [min(bounds, -(-v // 3)) for v in range(3 * bounds + 5)]
    pair = O._bounds_below(F.struct(F.col("id"), F.lit("b").alias("t")), "struct<id:bigint,t:string>", [F.struct(F.lit(i), F.lit("a")) for i in range(20)])
    assert [r["n"] for r in spark.range(0, 20).select(pair.alias("n")).collect()] == list(range(1, 21))
