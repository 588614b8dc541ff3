"""Ball k-means against plain k-means on whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from termgrid.llm import ballcodes, common, queries
from check_oracles import difference, oracle_connection

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds, scale):
    """code, error and label sums by comparing every part with every entry."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(float(np.float32(v)) * scale) for v in r[1]] for r in kept]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], p)[1] for c in cut]
            for k in range(len(book[p])):
                mine = [c[p] for c, o in zip(cut, own) if o == k]
                if mine:
                    book[p][k] = [sum(v) // len(mine) for v in zip(*mine)]
    digest = hashlib.sha256(",".join(str(v) for part in book for e in part for v in e).encode()).hexdigest()
    out = []
    for (i, _, label), c in zip(kept, cut):
        found = [nearest(c[p], p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    by_label = {}
    for _, _, e, label in out:
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def rows_of(seed, n, dims):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, dims))
    out = [(int(i), [float(np.float32(v)) for v in centers[i % 9] * 0.3 + rng.normal(size=dims) * 0.05], int(i % 4)) for i in rng.permutation(n)]
    out += [(n, None, 1), (n + 1, [None] + [0.0] * (dims - 1), 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf")] * dims, None), (n + 4, [], 2)]
    out += [(n + 5, [0.5] * dims, None), (n + 6, [0.5] * dims, None), (n + 6, [0.5] * dims, None), (None, [-1.25] * dims, 3), (0, [0.0] * dims, 0)]
    return out


@pytest.mark.parametrize("n, dims, parts, entries, rounds", [(400, 16, 4, 16, 2), (300, 8, 8, 64, 3), (20, 6, 2, 64, 2), (200, 4, 1, 1, 2), (200, 12, 3, 5, 0)])
def test_codes(spark, n, dims, parts, entries, rounds):
    rows = rows_of(n, n, dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ballcodes.compress(df, parts=parts, entries=entries, rounds=rounds)
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == plain(rows, parts, entries, rounds, 256)


def test_rings_skip_work_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    entries = rng.integers(-500, 500, (1, 64, 4))
    x = entries[0][rng.integers(0, 64, 4000)] + rng.integers(-30, 30, (4000, 4))
    all_pairs = ((x[:, None] - entries[0][None]) ** 2).sum(2)
    own = all_pairs.argmin(1)
    radii = np.array([[all_pairs[own == e, e].max(initial=0) for e in range(64)]])
    moved = entries + rng.integers(-3, 4, entries.shape) * (rng.random((1, 64, 1)) < 0.3)
    guide = ballcodes.balls(moved, entries, radii)
    compared = []
    real = ballcodes.squared
    monkeypatch.setattr(ballcodes, "squared", lambda a, b: compared.append(np.broadcast_shapes(a.shape, b.shape)[:-1]) or real(a, b))
    code, error = ballcodes.assign(x, own[:, None].astype(np.uint16), guide)
    want = ((x[:, None] - moved[0][None]) ** 2).sum(2)
    assert (code[:, 0] == want.argmin(1)).all() and (error == want.min(1)).all()
    assert sum(math.prod(s) for s in compared) < 0.2 * want.size
    assert guide.still.any() and (guide.gaps == ballcodes.UNBOUNDED).any()


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op11_ball_codes"
    verdict = difference(spark, oracle_connection(sf), name, queries.queries()[name], queries.oracle_sql()[name], sf)
    assert verdict.startswith("ok"), verdict


def test_bad_vectors_raise(spark):
    for vectors in ([[1.0, 2.0], [1.0]], [[1.0, 2.0, 3.0]], [[1e30, 0.0]]):
        df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)
        with pytest.raises(Exception, match="components expected|equal parts|a component beyond"):
            ballcodes.compress(df, parts=2).collect()


def test_empty_table_and_decompression(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ballcodes.compress(none).count() == 0
    df = spark.createDataFrame([(i, [i / 4, -i / 4], 0) for i in range(4)], SCHEMA)
    book, _ = ballcodes.fit(df, parts=2, entries=4)
    back = ballcodes.decompress(spark, ballcodes.compress(df, parts=2, entries=4), book).collect()
    assert all(abs(a - b) <= 1 / 256 for r in back for a, b in zip(r.restored, r.embedding))


def test_facts_of_many_keys_meet_hot_and_rare_ones(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_KEYS", 3)
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i if i % 3 == 1 else -1) for i in range(3000)], "id int, label int")
    sums = rows.groupBy("label").count().withColumnRenamed("label", "of")
    got = common.attach(rows, sums, "label", "of", "count")
    assert sorted((r["id"], r["count"]) for r in got.collect()) == [(i, 1 if i % 3 == 1 else 1000) for i in range(3000)]
