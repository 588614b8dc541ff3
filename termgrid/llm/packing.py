"""Best-fit packing of documents into training sequences, under several capacities at once.

A document's tokens end with an end token; longer documents than a sequence are
cut, the first piece taking what is left over.  A piece loads a sequence with
three things: its tokens, one document, and its attention cost (the square of its
length).  Vector best-fit goes through the pieces from the longest to the
shortest; of the open sequences whose every residual capacity holds the piece it
takes the one that fits best, by

* ``norm``: the least weighted norm of what would be left, or
* ``dot``: the greatest weighted dot product of the piece with what is left,

and opens a new sequence where none fits.  Loads are counted in shares of their
capacities; a load's weight is the share of all sequences that it fills, so scarce
capacities count most.

All pieces of one length are alike, so this runs on the histogram of lengths (at
most as many rows as a sequence has tokens) with sequences of equal residuals kept
as runs.  The result is that of packing piece by piece over the whole table, and
not over each partition by itself.  It is a short list of orders ("pieces 0 to
5,000 of length 600 go to sequences 70 on, one each, at place 400"); every piece
finds its own order by its length and its number among the pieces of that length.
Numbers come from counts per partition of a written table, so no length is ever
gathered in one task.

Defined results: null and empty texts are one piece, the end token; repeated rows
are packed each; an empty table gives an empty table; input columns stay, but
those that clash with the outputs (in any case) are replaced, and the text goes.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgrid.llm.bpe import encoded_blocks
from termgrid.llm.common import lists, unused, without
from termgrid.sources.scratch import materialize

OUTPUTS = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")


class Capacity(NamedTuple):
    """What a sequence holds: tokens, documents, and attention cost; None is no limit beyond the tokens' own."""

    tokens: int
    documents: int | None = None
    cost: int | None = None

    def limits(self) -> np.ndarray:
        if self.tokens < 1 or (self.documents is not None and self.documents < 1):
            raise ValueError("a sequence holds at least one token and one document")
        if self.cost is not None and self.cost < self.tokens**2:
            raise ValueError("the attention cost of one full piece is beyond the capacity")
        documents = self.tokens if self.documents is None else self.documents
        return np.array([self.tokens, documents, self.tokens**2 if self.cost is None else self.cost], dtype=np.int64)


class Order(NamedTuple):
    """Pieces first..end of a length fill sequences from ``sequence`` on, ``each`` to one, from place ``offset``."""

    length: int
    first: int
    end: int
    each: int
    sequence: int
    offset: int


def pack_lengths(histogram: dict[int, int], capacity: Capacity, rule: str = "norm") -> tuple[list[Order], int]:
    """Orders for every length, and the number of sequences."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    limits = capacity.limits()
    loads = sum(np.array([n * length, n, n * length**2], dtype=np.float64) for length, n in histogram.items())
    weights = loads / limits if histogram else np.ones(3)
    weights = weights / weights.sum()
    left = np.empty((0, 3), dtype=np.int64)  # residual capacities of each run of sequences
    runs: list[tuple[int, int]] = []  # first sequence and count of each run
    orders, sequences = [], 0

    def put(item, run_left, first_sequence, count, begin, n, each):
        """Put n items into a run, each to a sequence; returns the runs that come of it as (left, first, count)."""
        full, rest = divmod(n, each)
        orders.append(Order(int(item[0]), begin, begin + n, each, first_sequence, int(limits[0] - run_left[0])))
        made = [(run_left - each * item, first_sequence, full), (run_left - rest * item, first_sequence + full, 1 if rest else 0)]
        return [*made, (run_left, first_sequence + full + (rest > 0), count - full - (rest > 0))]

    for length in sorted(histogram, reverse=True):
        item, todo, begin = np.array([length, 1, length**2], dtype=np.int64), histogram[length], 0
        keep = left[:, 0] >= min(histogram)  # no other piece fits the rest
        left, runs = left[keep], [r for r, k in zip(runs, keep) if k]
        new = []
        fits = np.flatnonzero((left >= item).all(axis=1))
        if rule == "norm":
            score = -(weights * ((left[fits] - item) / limits) ** 2).sum(axis=1)
        else:
            score = (weights * (item / limits) * (left[fits] / limits)).sum(axis=1)
        gone = set()
        for at in fits[np.argsort(-score, kind="stable")]:
            if begin == todo:
                break
            first, count = runs[at]
            # a sequence that took one fits better than it did before, so by norm it is filled first; by dot the next one is
            each = int((left[at] // item).min()) if rule == "norm" else 1
            n = min(todo - begin, count * each)
            new += put(item, left[at], first, count, begin, n, each)
            begin += n
            gone.add(int(at))
        if begin < todo:
            each = int((limits // item).min())
            count = -(-(todo - begin) // each)
            new += put(item, limits, sequences, count, begin, todo - begin, each)
            sequences += count
        stay = [i for i in range(len(runs)) if i not in gone]
        new = [n for n in new if n[2] > 0]
        runs = [runs[i] for i in stay] + [(f, c) for _, f, c in new]
        left = np.concatenate([left[stay], np.array([l for l, _, _ in new], dtype=np.int64).reshape(-1, 3)])
    return orders, sequences


def cut_points(n: int, tokens: int) -> list[int]:
    """Where the pieces of n tokens start, and n; only the first piece may be short."""
    first = n % tokens or tokens
    return [0, *range(first, n + 1, tokens)] if n > tokens else [0, n]


def pieces(
    docs: DataFrame, vocabulary: str, tokens: int, end_id: int, text: str = "text", ids: bool = False,
    numbered: tuple[str, str] = ("_part", "_number"),
) -> DataFrame:
    """A row per piece: input columns without the text, piece, start, length, ids_crc32, maybe ids, and under the
    names ``numbered`` the partition, and the number among its pieces of this length."""
    base = without(docs, *(c for c in (*OUTPUTS, "ids") if c != text))
    fields = [f for f in base.schema.fields if f.name != text]
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = [*fields, T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    schema += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * ids
    schema += [T.StructField(numbered[0], T.IntegerType()), T.StructField(numbered[1], T.LongType())]

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(tokens + 1, dtype=np.int64)
        for _, rows, _, raw in encoded_blocks(batches, vocabulary, text):
            row, piece, start, length, crc, number = [], [], [], [], [], []
            raw = [r + end for r in raw]
            for i, r in enumerate(raw):
                cuts = cut_points(len(r) // 4, tokens)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(memoryview(r)[4 * a : 4 * b]))
                    number.append(int(seen[b - a]))
                    seen[b - a] += 1
            taken = pa.array(row, pa.int64())
            columns = [rows.column(f.name).take(taken) for f in fields]
            columns += [pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            if ids:  # the pieces follow one another as the documents' ids do
                columns.append(lists(np.concatenate(([0], np.cumsum(length))), np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32)))
            columns += [pa.array([part] * len(row), pa.int32()), pa.array(number, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return base.mapInArrow(run, T.StructType(schema))


def placed(ranked: DataFrame, orders: list[Order], number: str) -> DataFrame:
    """Add sequence_id and offset to pieces with their ``number`` among all pieces of their length."""
    by_length: dict[int, list[Order]] = {}
    for o in orders:
        by_length.setdefault(o.length, []).append(o)
    firsts = {length: np.array([o.first for o in found], dtype=np.int64) for length, found in by_length.items()}
    table = {length: np.array(found, dtype=np.int64) for length, found in by_length.items()}
    fields = ranked.schema.fields
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", number))
            out = np.empty((2, batch.num_rows), dtype=np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                order = table[int(one)][np.searchsorted(firsts[int(one)], rank[at], side="right") - 1]
                turn, inside = np.divmod(rank[at] - order[:, 1], order[:, 3])
                out[0, at], out[1, at] = order[:, 4] + turn, order[:, 5] + inside * one
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], schema.names)

    return ranked.mapInArrow(run, schema)


def pack(
    docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(1024), end_id: int = 2, text: str = "text",
    rule: str = "norm", ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    capacity.limits()
    part, number, before, rank = (unused(docs, n) for n in ("_part", "_number", "_before", "_rank"))
    cut = materialize(pieces(docs, vocabulary, capacity.tokens, end_id, text, ids, (part, number)), "pieces")
    counts = cut.groupBy("length", part).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn(before, F.coalesce(F.sum("n").over(upto), F.lit(0))), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity.tokens rows
    orders, _ = pack_lengths(histogram, capacity, rule)
    ranked = cut.join(counts.drop("n"), ["length", part]).withColumn(rank, F.col(before) + F.col(number))
    kept = [c for c in cut.columns if c not in (part, number)]
    return placed(ranked.select(*[f"`{c}`" for c in kept], rank), orders, rank).drop(rank)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of every sequence, from pieces packed with their ids."""
    members = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most capacity.tokens ids
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(members, lambda m: m["ids"])).alias("ids"))
