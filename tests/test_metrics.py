import math
import random

import pytest

from helpers import records
from termgrid.operators.metrics import metrics_long, score_metrics


def brute(rows, fraction=0.2):
    """rows: (key, y, p, guess) -> expected figures, ties in key order."""
    pos = sum(y for _, y, _, _ in rows)
    neg = len(rows) - pos
    pairs = [(p1 > p0) + (p1 == p0) / 2 for _, y1, p1, _ in rows if y1 for _, y0, p0, _ in rows if not y0]
    ap, seen, hit = 0.0, 0, 0
    for score in sorted({p for _, _, p, _ in rows}, reverse=True):
        same = [y for _, y, p, _ in rows if p == score]
        seen, hit = seen + len(same), hit + sum(same)
        ap += sum(same) / pos * hit / seen
    k = max(1, math.ceil(len(rows) * fraction))
    top = sorted(rows, key=lambda r: (-r[2], r[0]))[:k]
    return {
        "roc_auc": sum(pairs) / (pos * neg), "average_precision_ap": ap,
        "brier_score": sum((p - y) ** 2 for _, y, p, _ in rows) / len(rows),
        "positive_in_top_k": sum(r[1] for r in top), "recall_at_k_rows": k,
        "tp": sum(y and g for _, y, _, g in rows), "tn": sum(not y and not g for _, y, _, g in rows),
    }


@pytest.mark.parametrize("sizes", [{}, {"sample_rows": 6, "buckets": 3}])
def test_against_brute_force_with_hot_ties(spark, sizes):
    rng = random.Random(3)
    rows = []
    for model in ("a", "b"):
        for i in range(300):
            p = 0.9 if i % 3 == 0 else rng.randint(0, 20) / 20
            rows.append((model, f"k{i:03d}", rng.randint(0, 1), p, int(p >= 0.5)))
    df = spark.createDataFrame(rows, "model string, key string, y int, p double, guess int")
    for got in records(score_metrics(df, ["model"], "y", "p", "guess", tie_order=["key"], **sizes)):
        want = brute([r[1:] for r in rows if r[0] == got["model"]])
        for name, value in want.items():
            assert got[name] == pytest.approx(value), (got["model"], name)


def test_small_vector_one_class_and_ties_without_order(spark):
    y, p = [0, 1, 1, 0, 1], [0.1, 0.7, 0.6, 0.2, 0.9]
    rows = [("x", i, y[i], p[i], int(p[i] >= 0.5)) for i in range(5)] + [("one", i, 1, 0.4, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "model string, key int, y int, p double, guess int")
    out = {r["model"]: r for r in records(score_metrics(df, ["model"], "y", "p", "guess"))}
    assert (out["x"]["tn"], out["x"]["tp"]) == (2, 3)
    assert out["x"]["brier_score"] == pytest.approx(0.31 / 5)
    one = out["one"]
    assert one["status"] == "one_class" and one["roc_auc"] is None and one["tp"] is None
    assert one["precision"] == 0.0 and one["recall_at_k_status"] == "not_applicable_ties"
    long = records(metrics_long(score_metrics(df, ["model"], "y", "p", "guess"), ["f1", "recall"]))
    assert len(long) == 4
    with pytest.raises(ValueError):
        score_metrics(df, ["model"], "y", "p", "guess", fraction=0)
