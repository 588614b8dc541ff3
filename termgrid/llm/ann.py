"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Trees are grown on a bounded sample (``sample_rows``): a node splits at the
median along the difference of two random centres.  Every vector is routed to
one leaf of each tree.  A query searches all trees through one priority queue of
nodes, keyed by the smallest margin on the way, until the leaves it has taken
hold ``share`` times the number of indexed vectors (leaf sizes are counted over
all rows).  In each leaf the candidates are ranked exactly, in double precision
on the original vectors, and the best of all leaves are merged.

Inner products become angles by one more component that brings every indexed
vector to the length of the longest.  Leaves over ``BLOCK`` vectors are dealt to
several groups that each see the leaf's queries, so none is cut short.

Data without any structure needs a large share for a high recall (0.9 and more
of the 20 nearest at share 1.1 on isotropic vectors of 64 components, where leaves
overlap and some two thirds of the vectors are scored); clustered data needs far
less.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id; shorter vectors count as
padded with zeros; repeated rows count once and rows with the same id never
answer each other; ties go to the smaller id; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgrid.llm.vectors import classes, matrix, nearest, top_rows, valid
from termgrid.sources.scratch import materialize

TREES = 4
LEAVES = 64  # leaves of a tree
SHARE = 1.1
SAMPLE_ROWS = 20_000
BLOCK = 4096


class Forest(NamedTuple):
    normals: np.ndarray  # nodes x (dims + 1)
    offsets: np.ndarray
    children: np.ndarray  # nodes x 2: a node, or -1 - leaf
    roots: tuple[int, ...]
    leaves: int
    longest: float
    dims: int


def lengthen(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0.0))
    return np.hstack([x, rest[:, None]])


def grow(points: np.ndarray, longest: float, trees: int, leaves: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    dims = points.shape[1]
    points = lengthen(points, longest)
    normals, offsets, children, roots, count = [], [], [], [], 0

    def split(at: np.ndarray, parts: int) -> int:
        nonlocal count
        halves = None
        if parts > 1 and len(at) > 1:
            own = points[at]
            a, b = own[rng.integers(len(at))], own[rng.integers(len(at))]
            for _ in range(4):
                near = (own - (a + b) / 2) @ (a - b) > 0
                if near.all() or not near.any():
                    break
                a, b = own[near].mean(axis=0), own[~near].mean(axis=0)
            along = own @ (a - b)
            middle = np.median(along)
            if (along > middle).any():
                halves = at[along > middle], at[along <= middle]
        if halves is None:
            count += 1
            return -count
        node = len(normals)
        normals.append(a - b)
        offsets.append(middle)
        children.append([0, 0])
        children[node] = [split(halves[0], parts // 2), split(halves[1], parts - parts // 2)]
        return node

    for _ in range(trees):
        roots.append(split(np.arange(len(points)), leaves))
    scale = [max(np.linalg.norm(n), 1e-300) for n in normals]
    return Forest(
        np.array([n / s for n, s in zip(normals, scale)]).reshape(len(normals), dims + 1),
        np.array([o / s for o, s in zip(offsets, scale)]), np.array(children, dtype=np.int64).reshape(len(normals), 2),
        tuple(roots), count, longest, dims,
    )


def leaf_of(forest: Forest, x: np.ndarray) -> np.ndarray:
    """The leaf of each row in each tree."""
    margins = lengthen(x, forest.longest) @ forest.normals.T - forest.offsets
    out = np.empty((len(x), len(forest.roots)), dtype=np.int64)
    for t, root in enumerate(forest.roots):
        at = np.full(len(x), root, dtype=np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            right = margins[inner, at[inner]] <= 0
            at[inner] = forest.children[at[inner], right.astype(np.int64)]
        out[:, t] = -1 - at
    return out


def leaves_to_search(forest: Forest, sizes: np.ndarray, x: np.ndarray, wanted: float) -> list[list[int]]:
    """For each query the leaves taken from the shared queue until they hold the wanted number of vectors."""
    margins = np.hstack([x, np.zeros((len(x), 1))]) @ forest.normals.T - forest.offsets
    children, out = forest.children.tolist(), []
    for own in margins.tolist():
        queue = [(-np.inf, root) for root in forest.roots]
        heapq.heapify(queue)
        taken, held = [], 0.0
        while queue and held < wanted:
            margin, node = heapq.heappop(queue)
            if node < 0:
                taken.append(-1 - node)
                held += sizes[-1 - node]
                continue
            heapq.heappush(queue, (max(margin, -own[node]), children[node][0]))
            heapq.heappush(queue, (max(margin, own[node]), children[node][1]))
        out.append(taken)
    return out


def search(
    rows: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20,
    trees: int = TREES, leaves: int = LEAVES, share: float = SHARE, sample_rows: int = SAMPLE_ROWS, seed: int = 0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query among all other rows."""
    spark = rows.sparkSession
    sound = rows.where(F.col(vec_id).isNotNull() & valid(vector, zero_allowed=False)).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks")
    )
    index = materialize(classes(sound.select("id", "vector"), k), "ann-classes")
    queries = sound.where("asks").select("id", "vector").distinct().join(index.select("vid", "vector"), "vector").select(
        F.col("id").alias("query_id"), F.col("vid").alias("qvid"))
    queries = materialize(queries, "ann-queries")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = index.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"), F.max(square).alias("square")).first()
    if not facts["n"]:
        return empty
    dims, longest = facts["dims"], float(facts["square"]) ** 0.5
    portion = min(1.0, sample_rows / facts["n"])
    chosen = index.where(F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(1 << 20)) < int(portion * (1 << 20)) + 1)
    chosen = chosen.orderBy(F.xxhash64("vid", F.lit(seed)), "vid").limit(sample_rows).select("vector").toPandas()
    forest = spark.sparkContext.broadcast(grow(matrix(chosen["vector"], dims), longest, trees, leaves, seed))

    def route(batches):
        for batch in batches:
            found = leaf_of(forest.value, matrix(batch["vector"], dims))
            for t in range(found.shape[1]):
                yield pd.DataFrame({"leaf": found[:, t], "vid": batch["vid"], "vector": batch["vector"]})

    placed = materialize(index.select("vid", "vector").mapInPandas(route, "leaf long, vid long, vector array<double>"), "ann-leaves")
    counted = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # trees x leaves numbers
    sizes = np.array([counted.get(i, 0) for i in range(forest.value.leaves)], dtype=np.float64)
    wanted, groups = share * facts["n"], np.maximum(1, np.ceil(sizes / BLOCK)).astype(int)
    group_of = F.element_at(F.array(*[F.lit(int(g)) for g in groups]), (F.col("leaf") + 1).cast("int"))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("vid"), group_of))

    def ask(batches):
        for batch in batches:
            for start in range(0, len(batch), 1000):
                some = batch.iloc[start : start + 1000]
                taken = leaves_to_search(forest.value, sizes, matrix(some["vector"], dims), wanted)
                yield pd.DataFrame([
                    (leaf, part, q, v) for q, v, own in zip(some["qvid"], some["vector"], taken)
                    for leaf in own for part in range(groups[leaf])
                ], columns=["leaf", "part", "qvid", "vector"])

    asked = queries.select("qvid").distinct().join(index.select(F.col("vid").alias("qvid"), "vector"), "qvid")
    asked = asked.mapInPandas(ask, "leaf long, part long, qvid long, vector array<double>")

    def rank(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or held.empty:
            return pd.DataFrame({"qvid": [], "vid": [], "score": []})
        held = held.sort_values("vid")
        ids, q, v = held["vid"].to_numpy(), asking["qvid"].to_numpy(), matrix(held["vector"], dims)
        out = []
        for start in range(0, len(asking), 500):
            scores = matrix(asking["vector"].iloc[start : start + 500], dims) @ v.T
            for i, at in enumerate(top_rows(scores, ids, k + 1)):
                out.append((np.full(len(at), q[start + i]), ids[at], scores[i, at]))
        return pd.DataFrame({"qvid": np.concatenate([a for a, _, _ in out]), "vid": np.concatenate([b for _, b, _ in out]),
                             "score": np.concatenate([c for _, _, c in out])})

    partials = asked.groupBy("leaf", "part").cogroup(dealt.groupBy("leaf", "part")).applyInPandas(
        rank, "qvid long, vid long, score double")
    return nearest(partials, index, queries, k, "double")
