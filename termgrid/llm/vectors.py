"""What both vector searches share: valid rows, folding of equal vectors, merging of partial results.

Equal vectors are searched once: a class keeps its vector and its k + 1 smallest
ids, as many as any list of k neighbours can name.  The ranking inside a class
is cut before the shuffle, so a vector that very many rows share moves few rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(vector: str, zero_allowed: bool) -> Column:
    """Not null, not empty, no null or non-finite component; not zero unless allowed."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))
    return sound if zero_allowed else sound & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(vid, vector, ids): distinct vectors, the least id of each, and its k + 1 least ids."""
    per_class = Window.partitionBy("vector").orderBy("id")
    few = rows.distinct().withColumn("n", F.row_number().over(per_class)).where(F.col("n") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        F.element_at("ids", 1).alias("vid"), "vector", "ids"
    )


def nearest(partials: DataFrame, index: DataFrame, queries: DataFrame, k: int, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score) from (qvid, vid, score), classes and (query_id, qvid).

    The k + 1 best classes of a query vector hold its k + 1 best ids, ties to the
    smaller id; its own id goes afterwards, for each query with that vector.
    """
    best = Window.partitionBy("qvid").orderBy(F.desc("score"), "vid")
    # a class found in several places has the same score in all of them, but for rounding
    found = partials.groupBy("qvid", "vid").agg(F.max("score").alias("score"))
    few = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    named = few.join(index.select("vid", "ids"), "vid").select("qvid", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("qvid").orderBy(F.desc("score"), "vec_id")
    few = named.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    lists = few.groupBy("qvid").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    return queries.join(lists, "qvid").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", F.col("hit.score").cast(score).alias("score")
    )


def matrix(column, dims: int, dtype=np.float64) -> np.ndarray:
    """Rows of a list column; shorter vectors are padded with zeros."""
    out = np.zeros((len(column), dims), dtype=dtype)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores, the columns of its k best, ties to the smaller id; ids must ascend."""
    if scores.shape[1] <= k:
        return [np.arange(scores.shape[1])] * len(scores)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    out = []
    for row, limit in zip(scores, least):
        at = np.flatnonzero(row >= limit)
        out.append(at[np.lexsort((at, -row[at]))[:k]])
    return out


