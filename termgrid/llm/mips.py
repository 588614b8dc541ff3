"""Exact top-k by inner product over whole-number vectors: norm-sorted, pruned by Cauchy-Schwarz bounds.

Vectors are rotated by the singular vectors of the whole table (from the sum of
outer products, a dims x dims matrix), so their first coordinates hold most of
the length.  Sorted by descending length they are cut into blocks; a query's
first block, the longest vectors, gives a threshold.  For any later vector

    q.v <= q_head.v_head + |q_tail| |v_tail| <= |q| |v|

so whole blocks fall by the product of lengths, then single vectors by the
partial sum with the residual bound; only what is left is multiplied out, in
whole numbers.  Bounds get a slack for rounding, so nothing is lost.

Queries go against the table in blocks: a block of queries meets a block of
vectors only if the length bound of some query reaches its threshold.  Lengths
fall into bands, a quarter of an octave wide, and a block of queries is joined
on the bands it reaches; crowded bands are split by a salt that grows with the
table, so blocks meet by equal keys and no list of bounds is gathered.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without an id; zero vectors do; shorter
vectors count as padded with zeros; repeated rows count once and rows with the
same id never answer each other; ties go to the smaller id; an empty table gives
an empty result.  Scores are exact up to 2^63; longer vectors (squared length
beyond that) raise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgrid.llm.vectors import classes, matrix, nearest, valid
from termgrid.sources.scratch import materialize

VECTOR_BLOCK = 2048
QUERY_BLOCK = 512
HEAD = 16
SLACK = 1e-6
BANDS = 4  # for each doubling of the length
CROWD = 256  # blocks of a band that share a join key


def search(
    rows: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * vector), exactly."""
    spark = rows.sparkSession
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = rows.where(F.col(vec_id).isNotNull() & valid(vector, zero_allowed=True)).select(
        F.col(vec_id).cast("long").alias("id"), whole.alias("vector"), is_query.alias("asks")
    )
    index = classes(sound.select("id", "vector"), k).withColumn(
        "length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    index = materialize(index, "mips-classes")
    queries = sound.where("asks").select("id", "vector").distinct().join(index.select("vid", "vector"), "vector").select(
        F.col("id").alias("query_id"), F.col("vid").alias("qvid"))
    queries = materialize(queries, "mips-queries")
    facts = index.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"), F.max("length").alias("longest")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = facts["dims"]
    if facts["longest"] ** 2 >= 2.0 ** 63:
        raise ValueError(f"a vector of length {facts['longest']:.3g} after scaling: its products don't fit 64 bits")

    def gram(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch["vector"], dims)
            total += x.T @ x
        yield pd.DataFrame({"i": range(dims), "row": list(total)})

    parts = index.select("vector").mapInPandas(gram, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((dims, dims))
    for r in sums:  # dims x dims numbers
        total[r["i"], r["j"]] = r["x"]
    rotation = np.linalg.eigh(total)[1][:, ::-1].copy()  # the strongest direction first

    def packed(batches, key: str, size: int):
        """Blocks of consecutive rows as one row each."""
        held = None
        for batch in batches:
            held = batch if held is None or held.empty else pd.concat([held, batch])
            while len(held) >= size:
                yield block_row(held.iloc[:size], key)
                held = held.iloc[size:]
        if held is not None and len(held):
            yield block_row(held, key)

    def block_row(some: pd.DataFrame, key: str) -> pd.DataFrame:
        x = matrix(some["vector"], dims, np.int64)
        return pd.DataFrame({
            "longest": [float(some["length"].max())], "n": [len(some)], "ids": [some[key].to_numpy(np.int64).tobytes()],
            "x": [x.tobytes()],
        })

    schema = "longest double, n long, ids binary, x binary"
    # ranges by length: a partition's rows come in descending length, and so do the partitions
    lengths = index.select("vid", "vector", "length").repartitionByRange(
        -(-facts["n"] // (8 * VECTOR_BLOCK)), F.desc("length"), "vid").sortWithinPartitions(F.desc("length"), "vid")
    blocks = materialize(lengths.mapInPandas(lambda b: packed(b, "vid", VECTOR_BLOCK), schema), "mips-blocks")
    asked = queries.select("qvid").distinct().join(index.select(F.col("vid").alias("qvid"), "vector", "length"), "qvid")
    asked = materialize(asked.repartition("qvid").mapInPandas(lambda b: packed(b, "qvid", QUERY_BLOCK), schema), "mips-asked")
    longest = blocks.orderBy(F.desc("longest"), "n", F.xxhash64("ids")).limit(1).first()  # one block
    first = spark.sparkContext.broadcast((longest["ids"], longest["x"]))

    def threshold(batches):
        """The k+1 best scores of each query in the block of the longest vectors."""
        v = np.frombuffer(first.value[1], dtype=np.int64).reshape(-1, dims).astype(np.float64)
        for batch in batches:
            limits = []
            for x in batch["x"]:
                q = np.frombuffer(x, dtype=np.int64).reshape(-1, dims).astype(np.float64)
                scores = q @ v.T
                limits.append(
                    np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, -k - 1].tobytes() if scores.shape[1] > k
                    else np.full(len(q), -np.inf).tobytes()
                )
            batch["limits"] = limits
            batch["reach"] = [  # how long a vector must be to matter to some query
                min(reach_of(np.frombuffer(x, dtype=np.int64).reshape(-1, dims), np.frombuffer(limit))) for x, limit in zip(batch["x"], limits)
            ]
            yield batch

    def reach_of(q: np.ndarray, limits: np.ndarray) -> np.ndarray:
        size = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        return np.where((limits > 0) & (size > 0), limits / np.where(size > 0, size, 1) * (1 - SLACK), 0.0)

    asked = materialize(asked.mapInPandas(threshold, schema + ", limits binary, reach double"), "mips-reach")
    band = lambda length: F.floor(F.lit(BANDS) * F.log2(F.col(length) + 1.0))
    top = int(BANDS * np.log2(facts["longest"] + 1.0)) + 1
    salts = -(-facts["n"] // (VECTOR_BLOCK * CROWD))
    known = blocks.select(F.xxhash64("ids").alias("block"), "longest").select(
        "block", "longest", band("longest").alias("band"), F.pmod("block", F.lit(salts)).alias("salt"))
    reached = F.when(band("reach") <= top, F.sequence(band("reach"), F.lit(top).cast("long")))
    wanted = asked.select(F.xxhash64("ids").alias("asker"), "reach", F.explode(reached).alias("band")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    # pairs of block numbers first, three numbers each; the blocks themselves follow by number
    meets = wanted.join(known, ["band", "salt"]).where("longest >= reach").select("asker", "block")
    pairs = meets.join(
        asked.select(F.xxhash64("ids").alias("asker"), F.col("ids").alias("qids"), F.col("x").alias("qx"), "limits"), "asker"
    ).join(blocks.select(F.xxhash64("ids").alias("block"), "ids", "x"), "block")

    def score(batches):
        for batch in batches:
            for qids, qx, limits, ids, x in zip(batch["qids"], batch["qx"], batch["limits"], batch["ids"], batch["x"]):
                yield scored(
                    np.frombuffer(qids, dtype=np.int64), np.frombuffer(qx, dtype=np.int64).reshape(-1, dims), np.frombuffer(limits),
                    np.frombuffer(ids, dtype=np.int64), np.frombuffer(x, dtype=np.int64).reshape(-1, dims), rotation, k,
                )

    partials = pairs.select("qids", "qx", "limits", "ids", "x").mapInPandas(score, "qvid long, vid long, score long")
    return nearest(partials, index, queries, k, "long")


def scored(qids, q, limits, ids, v, rotation, k) -> pd.DataFrame:
    """Rows (qvid, vid, score) of one query block against one vector block: everything that may be among the k+1 best."""
    head = min(HEAD, q.shape[1])
    rq, rv = q @ rotation, v @ rotation
    tail_q, tail_v = np.linalg.norm(rq[:, head:], axis=1), np.linalg.norm(rv[:, head:], axis=1)
    bound = rq[:, :head] @ rv[:, :head].T + np.outer(tail_q, tail_v)
    slack = SLACK * np.outer(np.linalg.norm(rq, axis=1), np.linalg.norm(rv, axis=1)) + SLACK
    near = bound + slack >= limits[:, None]
    least = limits - 1e-9 * np.abs(limits)  # limits are doubles: beyond 2^53 they may lie a little above the whole number
    out_q, out_v, out_s = [], [], []
    for i in np.flatnonzero(near.any(axis=1)):
        at = np.flatnonzero(near[i])
        exact = v[at] @ q[i]
        at, exact = at[exact >= least[i]], exact[exact >= least[i]]
        best = np.lexsort((ids[at], -exact))[: k + 1]
        out_q.append(np.full(len(best), qids[i]))
        out_v.append(ids[at[best]])
        out_s.append(exact[best])
    if not out_q:
        return pd.DataFrame({"qvid": [], "vid": [], "score": []}, dtype=np.int64)
    return pd.DataFrame({"qvid": np.concatenate(out_q), "vid": np.concatenate(out_v), "score": np.concatenate(out_s)})
