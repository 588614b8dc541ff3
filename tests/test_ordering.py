import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from termgrid.operators import ordering as O


@pytest.fixture(scope="module")
def values():
    """A third of all rows share one value; some rows have none."""
    rng = random.Random(7)
    return [(i, 5.0 if i % 3 == 0 else None if i % 17 == 0 else rng.randint(0, 400) / 8) for i in range(3000)]


@pytest.mark.parametrize("sizes", [{}, {"sample_rows": 30, "buckets": 7}])
def test_rank_and_quantile_match_brute_force(spark, values, sizes):
    df = spark.createDataFrame(values, "id int, v double")
    counts = O.value_counts(df, "v", **sizes)
    assert counts.rows == len({v for _, v in values if v is not None})
    limit = 50 if sizes else O.BROADCAST_ROWS
    got = {r["id"]: r["rank"] for r in O.with_rank(df, "v", "rank", counts, limit).collect()}
    series = pd.Series([v for _, v in values], dtype="float64")
    want = series.rank(method="min", ascending=False)
    assert len(got) == len(values)
    assert all(got[i] == (None if pd.isna(w) else int(w)) for i, w in enumerate(want))
    for q in (0.1, 0.5, 0.75, 0.999):
        assert O.exact_quantile(counts, "v", q) == pytest.approx(series.quantile(q))


def test_text_order_and_groups(spark):
    rows = [(g, f"k{i:04d}", i % 5) for g in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k string, x int")
    table = O.running_totals(df, ["k"], {"x": F.sum("x"), "n": F.count("*")}, ["g"], sample_rows=16, buckets=4).table
    pdf = table.toPandas().sort_values(["g", "k"])
    assert (pdf["n_through"] == pdf.groupby("g")["n"].cumsum()).all()
    assert (pdf["x_through"] == pdf.groupby("g")["x"].cumsum()).all()
    assert (pdf["n_total"] == 200).all()


@pytest.mark.parametrize("limit", [O.BROADCAST_ROWS, 50])
def test_several_ranks_at_once(spark, values, limit):
    rows = [(i, v, None if v is None else -v if i % 4 else 1.0, float(i % 7)) for i, v in values]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    counts = O.measure_counts(df, ["a", "b", "c"], sample_rows=30, buckets=7)
    got = {r["id"]: (r["ra"], r["rb"], r["rc"]) for r in O.with_ranks(df, {"a": "ra", "b": "rb", "c": "rc"}, counts, limit).collect()}
    want = [pd.Series([r[k] for r in rows], dtype="float64").rank(method="min", ascending=False) for k in (1, 2, 3)]
    assert len(got) == len(rows)
    for (i, *_), wants in zip(rows, zip(*want)):
        assert got[i] == tuple(None if pd.isna(w) else int(w) for w in wants)


def test_plans_grow_with_the_number_of_ranks(spark, values):
    df = spark.createDataFrame([(i, v, v, v, v) for i, v in values], "id int, a double, b double, c double, d double")
    sizes = []
    for names in ("ab", "abc", "abcd"):
        ranked = O.with_ranks(df, {n: f"r{n}" for n in names}, broadcast_rows=0)
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        sizes.append((plan.count("Join "), plan.count("Relation"), plan.count("Union")))
    assert [s[0] for s in sizes] == [4, 6, 8] and {s[2] for s in sizes} == {0}
    assert sizes[2][1] - sizes[1][1] == sizes[1][1] - sizes[0][1]
