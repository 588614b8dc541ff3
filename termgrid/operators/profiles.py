"""Descriptive course profiles: train-only means, K-Means, chosen by silhouette."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgrid.operators.backtest import scale_parameters, scaled
from termgrid.sources.scratch import materialize
from termgrid.spec import (
    COURSE_KEY, PROFILE_MAX_K, PROFILE_MIN_ROWS, PROFILE_MIN_SILHOUETTE, RANDOM_STATE, SHARES,
)

PROFILE_COLUMNS = (
    "course_level", "students", "grade_total", *SHARES, "historical_w_proxy_mean",
    "historical_demand_proxy_mean", "historical_students_mean", "historical_grade_total_mean",
    "historical_term_count", "w_proxy",
)

MAX_ITERATIONS = 300
FITS_AT_ONCE = 4
STARTS_APART = 50_000  # courses up to which each fit takes Spark's own start, some eight passes over the points
START_STEPS = 2  # rounds in which a start gathers candidates
START_ITERATIONS = 30  # on the few candidates of a start
TOLERANCE = 1e-4  # a centre that moves less has arrived
EQUAL_COSTS = 1e-9  # costs of fits that differ by less, relatively, are equal
POINTS_AT_ONCE = 1024


@dataclass
class Profiles:
    rows: DataFrame | None
    status: str
    reason: str = ""
    best_k: int | None = None
    silhouette: float | None = None
    centers: list[dict] = field(default_factory=list)


def profile_means(rows: DataFrame) -> DataFrame:
    """Mean of every profile column per course, over train rows."""
    train = rows.where(F.col("split") == "train")
    columns = [c for c in PROFILE_COLUMNS if c in rows.columns]
    return train.groupBy(*COURSE_KEY).agg(*[F.avg(c).alias(c) for c in columns])


def course_profiles(
    rows: DataFrame,
    min_rows: int = PROFILE_MIN_ROWS,
    max_k: int = PROFILE_MAX_K,
    min_silhouette: float = PROFILE_MIN_SILHOUETTE,
    restarts: int = 20,
    seed: int = RANDOM_STATE,
) -> Profiles:
    """Cluster courses; skipped with a reason when the data cannot carry it.

    For every K the cheapest of ``restarts`` seeded fits counts; K with the best
    silhouette (squared Euclidean) wins, the smaller K on ties.  The fits of all K are
    improved together, and of many courses started together (``started_together``).
    """
    means = materialize(profile_means(rows), "profile_means")
    columns = [c for c in PROFILE_COLUMNS if c in means.columns]
    seen = means.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns]).first()
    used = [c for c in columns if seen[c]]
    courses = seen["_rows"]
    if courses < min_rows:
        return Profiles(None, "skipped", "too_few_train_courses")
    if len(used) < 2:
        return Profiles(None, "skipped", "fewer_than_two_numeric_profile_features")
    upper = min(max_k, courses - 1)
    if upper < 2:
        return Profiles(None, "skipped", "not_enough_rows_for_two_clusters")
    parameters = sorted(scale_parameters(means, used).collect(), key=lambda r: used.index(r["feature"]))
    z = [f"z_{c}" for c in used]
    points = VectorAssembler(inputCols=z, outputCol="features").transform(scaled(means, parameters))
    points = points.select(*COURSE_KEY, *z, "features").persist()
    kept = None
    try:
        distinct = points.select(*z).distinct().limit(upper + 1).count()
        evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
        sizes = [k for k in range(2, upper + 1) if distinct > k]
        kept = packed(points, COURSE_KEY).persist()
        wanted = [k for k in sizes for _ in range(restarts)]
        if courses > STARTS_APART:
            starts = started_together(kept, wanted, seed)
        else:
            def start(i: int):
                return KMeans(k=wanted[i], maxIter=0, seed=seed + i % restarts, predictionCol="cluster").fit(points)

            with ThreadPoolExecutor(FITS_AT_ONCE) as pool:  # small jobs over the same persisted points
                starts = [np.array(model.clusterCenters()) for model in pool.map(start, range(len(wanted)))]
        fits = improved_together(kept, starts)
        best = None
        for i, k in enumerate(sizes):
            of_k = fits[i * restarts:(i + 1) * restarts]
            least = min(fit.cost for fit in of_k)
            # sums of the same fit differ in their last digits: the first restart among equals counts
            fit = next(fit for fit in of_k if fit.cost <= least * (1 + EQUAL_COSTS))
            labelled = with_cluster(points, fit.centers)
            if len(fit.centers) < 2 or labelled.select("cluster").distinct().limit(2).count() < 2:
                continue
            score = evaluator.evaluate(labelled)
            if best is None or score > best[0]:
                best = (score, k, fit.centers)
    finally:
        points.unpersist()
        if kept is not None:
            kept.unpersist()
    if best is None:
        return Profiles(None, "skipped", "silhouette_unavailable")
    score, k, found = best
    if score < min_silhouette:
        return Profiles(None, "skipped", "silhouette_below_quality_floor", k, score)
    labelled = with_cluster(points, found).select(*COURSE_KEY, F.col("cluster").cast("long").alias("cluster"))
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    out = labelled.join(sizes, "cluster").select(
        *COURSE_KEY, "cluster", "cluster_size", F.lit(float(score)).alias("silhouette"), F.lit("ok").alias("status")
    )
    centers = [
        {"cluster": i, **{r["feature"]: round(float(v) * (r["std"] or 1.0) + r["mean"], 10) for r, v in zip(parameters, center)}}
        for i, center in enumerate(found)
    ]
    return Profiles(out, "ok", "", k, float(score), centers)


@dataclass
class Fit:
    centers: np.ndarray
    cost: float = 0.0


def packed(points: DataFrame, keys=()) -> DataFrame:
    """Points by the thousand: their values one after the other as ``values``, and a hash of each one's key as ``hashes``.

    Every pass over the points reads these few rows instead of a row per point.
    """
    schema = "width int, values binary, hashes binary"
    point = vector_to_array("features")

    def run(batches):
        for batch in batches:
            column = batch.column("point")
            values = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), "float64").reshape(len(column), -1)
            hashes = np.ascontiguousarray(batch.column("hash").to_numpy(zero_copy_only=False), "int64")
            for first in range(0, len(values), POINTS_AT_ONCE):
                part = slice(first, first + POINTS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([
                    pa.array([values.shape[1]], pa.int32()), pa.array([values[part].tobytes()], pa.binary()),
                    pa.array([hashes[part].tobytes()], pa.binary())], ["width", "values", "hashes"])

    return points.select(point.alias("point"), F.xxhash64(*keys, *([] if keys else [point])).alias("hash")).mapInArrow(run, schema)


def _unpacked(batches):
    """(values, hashes) of every row of ``packed``."""
    for batch in batches:
        for row in batch.to_pylist():
            yield np.frombuffer(row["values"]).reshape(-1, row["width"]), np.frombuffer(row["hashes"], "uint64")


def _by_chance(hashes: np.ndarray, *draw: int) -> np.ndarray:
    """Numbers from 0 to 1 that follow from a point's hash and the number of the draw alone, however the points lie."""
    def mixed(v):
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))

    salt = np.zeros(1, "uint64")
    for number in draw:
        salt = mixed(salt + np.uint64(0x9E3779B97F4A7C15) + np.uint64(number))
    return (mixed(hashes + salt) >> np.uint64(11)) * 2.0**-53


def _square_distances(x: np.ndarray, centers: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """A row per centre, a column per point; never below 0."""
    return np.maximum(norms[:, None] - 2 * (centers @ x.T) + (x * x).sum(1), 0)


def started_together(kept: DataFrame, sizes: list[int], seed: int) -> list[np.ndarray]:
    """Starting centres of one fit per entry of ``sizes``, by k-means|| for all fits at once.

    As in Spark's own start a fit takes a point by chance, gathers some 2 k further
    candidates in each of two rounds, the likelier the farther from those it has, and
    draws its k centres from the candidates by k-means++, weighted by the points nearest
    to them.  A round is two passes over the points, whatever the number of fits.
    """
    if not sizes:
        return []
    drawn = "fit int, chance double, point array<double>"

    def first(batches):
        least: dict[int, tuple[float, list[float]]] = {}
        for x, hashes in _unpacked(batches):
            for i in range(len(sizes)):
                chance = _by_chance(hashes, seed, i, 0)
                at = int(chance.argmin())
                if i not in least or chance[at] < least[i][0]:
                    least[i] = float(chance[at]), x[at].tolist()
        if least:
            yield pa.RecordBatch.from_pylist([{"fit": i, "chance": c, "point": p} for i, (c, p) in least.items()], _DRAWN)

    found = kept.mapInArrow(first, drawn).groupBy("fit").agg(F.min_by("point", "chance").alias("point"))
    candidates = [np.array([r["point"]]) for r in sorted(found.collect(), key=lambda r: r["fit"])]

    def stacked():
        centers = np.concatenate(candidates)
        return centers, (centers * centers).sum(1), np.cumsum([0] + [len(c) for c in candidates])

    for step in range(1, START_STEPS + 1):
        centers, norms, places = stacked()

        def costs(batches):
            total = np.zeros(len(sizes))
            for x, _ in _unpacked(batches):
                total += np.minimum.reduceat(_square_distances(x, centers, norms), places[:-1], axis=0).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int32()), pa.array(total)], ["fit", "cost"])

        summed = kept.mapInArrow(costs, "fit int, cost double").groupBy("fit").agg(F.sum("cost").alias("cost"))
        cost = {r["fit"]: r["cost"] for r in summed.collect()}
        share = [2.0 * k / cost[i] if cost[i] else 0.0 for i, k in enumerate(sizes)]

        def farther(batches):
            for x, hashes in _unpacked(batches):
                least = np.minimum.reduceat(_square_distances(x, centers, norms), places[:-1], axis=0)
                taken = [(i, at) for i in range(len(sizes))
                         for at in np.flatnonzero(_by_chance(hashes, seed, i, step) < least[i] * share[i]).tolist()]
                if taken:
                    yield pa.RecordBatch.from_pylist([{"fit": i, "chance": 0.0, "point": x[at].tolist()} for i, at in taken], _DRAWN)

        more: dict[int, list] = {}
        for r in kept.mapInArrow(farther, drawn).collect():  # some 2 k a fit
            more.setdefault(r["fit"], []).append(r["point"])
        candidates = [np.concatenate([c, sorted(more[i])]) if i in more else c for i, c in enumerate(candidates)]

    candidates = [np.unique(c, axis=0) for c in candidates]
    centers, norms, places = stacked()

    def nearest(batches):
        weights = np.zeros(len(centers), "int64")
        for x, _ in _unpacked(batches):
            far = _square_distances(x, centers, norms)
            for low, high in zip(places, places[1:]):
                weights[low:high] += np.bincount(far[low:high].argmin(0), minlength=high - low)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centers)), pa.int32()), pa.array(weights)], ["candidate", "n"])

    counted = kept.mapInArrow(nearest, "candidate int, n long").groupBy("candidate").agg(F.sum("n").alias("n"))
    weights = np.zeros(len(centers))
    for r in counted.collect():
        weights[r["candidate"]] = r["n"]
    return [_drawn_centers(c, weights[low:high], sizes[i], np.random.default_rng([seed, i]))
            for i, (c, low, high) in enumerate(zip(candidates, places, places[1:]))]


_DRAWN = pa.schema([("fit", pa.int32()), ("chance", pa.float64()), ("point", pa.list_(pa.float64()))])


def _drawn_centers(points: np.ndarray, weights: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++ and a few steps of Lloyd's on the weighted candidates of one start."""
    if len(points) <= k:
        return points
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    apart = lambda centers: ((points[:, None, :] - centers[None]) ** 2).sum(2)
    for _ in range(1, k):
        pull = weights * apart(points[chosen]).min(1)
        chosen.append(int(rng.choice(len(points), p=pull / pull.sum())) if pull.sum() else chosen[0])
    centers = points[chosen].copy()
    before = None
    for _ in range(START_ITERATIONS):
        nearest = apart(centers).argmin(1)
        if before is not None and (nearest == before).all():
            break
        for j in range(k):
            own = nearest == j
            if weights[own].sum():
                centers[j] = (points[own] * weights[own, None]).sum(0) / weights[own].sum()
            else:
                centers[j] = points[int(rng.integers(len(points)))]
        before = nearest
    return centers


def _moved(kept: DataFrame, centers: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, np.ndarray, float]]:
    """Per (fit, cluster): how many points are nearest to the centre and their sum; with cluster 0 the fit's squared distances.

    One pass over the points for all fits; a task hands on a row per fit and cluster.
    """
    # centres of one number in fits of one size stand side by side: they are compared with a point at once
    sizes = sorted({len(c) for c in centers})
    order = [(i, j) for k in sizes for j in range(k) for i, c in enumerate(centers) if len(c) == k]
    widths = {k: sum(len(c) == k for c in centers) for k in sizes}
    stacked = np.array([centers[i][j] for i, j in order])
    norms = (stacked * stacked).sum(1)
    schema = "fit int, cluster int, n long, sums array<double>, cost double"

    def run(batches):
        counts, sums, costs = np.zeros(len(order), "int64"), np.zeros_like(stacked), np.zeros(len(order))
        for x, _ in _unpacked(batches):
            far = _square_distances(x, stacked, norms)
            chosen = np.zeros(far.shape, bool)
            at = 0
            for k in sizes:
                width = widths[k]
                of_k = far[at:at + k * width].reshape(k, width, len(x))
                least = of_k.min(0)
                first = chosen[at:at + k * width].reshape(k, width, len(x))
                np.equal(of_k, least, out=first)
                taken = first[0].copy()
                for j in range(1, k):  # the first among equals
                    first[j] &= ~taken
                    taken |= first[j]
                costs[at:at + width] += least.sum(1)
                at += k * width
            counts += chosen.sum(1)
            sums += chosen.astype("float64") @ x
        yield pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in order], pa.int32()), pa.array([j for _, j in order], pa.int32()), pa.array(counts),
            pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(costs)], ["fit", "cluster", "n", "sums", "cost"])

    totals = kept.mapInArrow(run, schema).groupBy("fit", "cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(stacked.shape[1])]).alias("sums"), F.sum("cost").alias("cost"))
    return {(r["fit"], r["cluster"]): (r["n"], np.array(r["sums"]), r["cost"]) for r in totals.collect()}


def improved_together(points: DataFrame, starts: list[np.ndarray], most: int = MAX_ITERATIONS, tolerance: float = TOLERANCE) -> list[Fit]:
    """Lloyd's steps of all fits at once, each until none of its centres moves by more than the tolerance.

    Every step is one pass over the points (``packed`` or with their features), whatever the
    number of fits, and a fit that has ended takes no further part.  A centre without points stays.
    """
    points = points if "hashes" in points.columns else packed(points)
    fits = [Fit(centers.copy()) for centers in starts]
    going = list(range(len(fits)))
    for _ in range(most):
        if not going:
            break
        found = _moved(points, [fits[i].centers for i in going])
        still = []
        for place, i in enumerate(going):
            old, new = fits[i].centers, fits[i].centers.copy()
            for cluster in range(len(old)):
                n, total, _ = found[place, cluster]
                if n:
                    new[cluster] = total / n
            fits[i] = Fit(new, sum(found[place, cluster][2] for cluster in range(len(old))))
            if (((new - old) ** 2).sum(1) > tolerance * tolerance).any():
                still.append(i)
        going = still
    return fits


def with_cluster(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """Number of the nearest centre as ``cluster``, the first among equals."""
    centers = np.array(centers)

    def nearest(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), centers.shape[1])
        apart = np.array([((x - center) ** 2).sum(1) for center in centers])
        return pa.array(apart.argmin(0).astype("int32"))

    return points.withColumn("cluster", F.arrow_udf(nearest, "int")(vector_to_array("features")))


def cluster_sizes(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("cluster").agg(F.count(F.lit(1)).alias("course_count"))
