"""Vector code compression: product codes from codebooks fitted by ball k-means, exact in whole numbers.

Vectors become whole numbers, ``floor(scale * x)``, and are cut into equal
consecutive parts.  Each part position has a codebook; a vector's code names the
nearest entry of every part.  The codebooks start as the parts of the vectors
with the least ids, and each round assigns all parts and then moves every entry
to the floored mean of its parts.

Assignment follows the balls.  An entry and its parts are a ball; its radius is
the distance of its farthest part.

* *Neighbour entries.*  With own entry ``c`` and another entry ``e``, a part ``x``
  can only move to ``e`` if ``|c - e| <= 2 |x - c|``, so only entries within twice
  the ball's radius are neighbours.  Radii come with the sums of the round before;
  after an entry moved, its old radius and the length of the move bound the new one.
* *Stable cores.*  A part with ``2 |x - c|`` below the distance of the nearest
  neighbour keeps its entry, and so do all parts of a ball that didn't move and
  none of whose neighbours did.  No distance but the own one is taken there.
* *Annular rings.*  Other parts lie in rings: between the k-th and the next
  neighbour's half distance only the k nearest neighbours are candidates, and
  their distances are compared exactly, ties to the lower index.

In the first round nothing is known: all parts start in the first entry's ball,
whose radius is unbounded.

All comparisons are between squared whole numbers, so results don't depend on
the partitioning.  Each round is one job that writes vectors with their codes to
the shared folder, and one that sums by (part, entry) inside each task and then
over the tasks; what reaches the driver is the codebooks, whose size is parts x
entries x width whatever the rows.

Defined results: rows whose vector is null, empty, or holds null or non-finite
components are dropped.  Repeated rows count as often as they stand there.  Null
ids come last when the codebooks start; equal ids are ordered by their vectors.
With fewer rows than entries there are fewer entries.  A null label is a label of
its own.  An empty table gives an empty table.  Input columns stay, but those that
clash with the outputs (in any case) are replaced.  Vectors of different lengths,
lengths that the parts don't divide, and components so large that squared
distances would leave 64 bits raise a ValueError.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgrid.llm.common import attach, unused, without
from termgrid.llm.vectors import valid
from termgrid.sources.scratch import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
SLICE = 4096  # vectors worked on at a time
UNBOUNDED = np.iinfo(np.int64).max


class Balls(NamedTuple):
    """Codebooks with the neighbour lists that an assignment follows."""

    entries: np.ndarray  # (parts, entries, width)
    order: np.ndarray  # (parts, entries, entries): other entries, neighbours first, by distance
    gaps: np.ndarray  # (parts, entries, entries): squared distances in that order, UNBOUNDED beyond the neighbours
    still: np.ndarray  # (parts, entries): neither the entry nor a neighbour moved since the last assignment


def balls(entries: np.ndarray, before: np.ndarray | None = None, radii: np.ndarray | None = None) -> Balls:
    """Neighbour lists of the entries; ``radii`` are squared and belong to the entries ``before``."""
    parts, k, _ = entries.shape
    order = np.zeros((parts, k, k), dtype=np.int64)
    gaps = np.full((parts, k, k), UNBOUNDED, dtype=np.int64)
    still = np.zeros((parts, k), dtype=bool)
    moved = np.ones((parts, k), dtype=bool) if before is None else (entries != before).any(axis=2)
    for p in range(parts):
        between = ((entries[p][:, None, :] - entries[p][None, :, :]) ** 2).sum(axis=2)
        for e in range(k):
            near = np.lexsort((np.arange(k), between[e]))
            near = near[near != e]
            if radii is not None:
                shift = math.isqrt(int(((entries[p, e] - before[p, e]) ** 2).sum())) + 1
                reach = 2 * (math.isqrt(int(radii[p, e])) + 1 + shift)  # rounded up, so no neighbour is missed
                near = near[between[e][near] <= reach * reach]
                still[p, e] = not moved[p, e] and not moved[p, near].any()
            order[p, e, : len(near)] = near
            gaps[p, e, : len(near)] = between[e][near]
    return Balls(entries, order, gaps, still)


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((x - entry) ** 2).sum(axis=-1)


def assign_part(x: np.ndarray, own: np.ndarray, book: Balls, p: int) -> tuple[np.ndarray, np.ndarray]:
    """New entry and squared distance of every part x, given its entry so far."""
    entries = book.entries[p]
    entry, distance = own.copy(), squared(x, entries[own])
    core = book.gaps[p][:, 0] if len(entries) > 1 else np.full(1, UNBOUNDED)
    active = np.flatnonzero(~book.still[p][own] & (4 * distance >= core[own]))
    active = active[np.argsort(own[active], kind="stable")]
    for ball in np.split(active, np.flatnonzero(np.diff(own[active])) + 1):
        if not len(ball):
            continue
        e = own[ball[0]]
        ring = np.searchsorted(book.gaps[p, e], 4 * distance[ball], side="right")
        for k in np.unique(ring):
            at, near = ball[ring == k], book.order[p, e, :k]
            found = squared(x[at][:, None, :], entries[near][None, :, :])
            least = found.min(axis=1)
            first = np.where(found == least[:, None], near[None, :], len(entries)).min(axis=1)
            better = (least < distance[at]) | ((least == distance[at]) & (first < e))
            entry[at[better]], distance[at[better]] = first[better], least[better]
    return entry, distance


def assign(numbers: np.ndarray, codes: np.ndarray, book: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and error (squared distances summed over the parts) of whole-number vectors."""
    parts, _, width = book.entries.shape
    out, error = np.empty_like(codes), np.zeros(len(numbers), dtype=np.int64)
    for p in range(parts):
        out[:, p], distance = assign_part(numbers[:, p * width : (p + 1) * width], codes[:, p].astype(np.int64), book, p)
        error += distance
    return out, error


def whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a column of equally long vectors."""
    lengths = np.diff(np.asarray(column.offsets))
    if (lengths != dims).any():
        raise ValueError(f"vectors of {dims} components expected, one has {int(lengths[lengths != dims][0])}")
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if values.size and np.abs(values).max() > math.isqrt(2**58 // dims):
        raise ValueError(f"a component beyond {math.isqrt(2**58 // dims) / scale}: squared distances would leave 64 bits")
    return values.astype(np.int64).reshape(-1, dims)


def _slices(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            yield batch.slice(first, SLICE)


def _codes(batch: pa.RecordBatch, name: str, parts: int) -> np.ndarray:
    raw = b"".join(batch.column(name).to_pylist())
    return np.frombuffer(raw, dtype=np.uint16).reshape(-1, parts)


def assigned(kept: DataFrame, book: Balls, vector: str, scale: int, codes_name: str) -> DataFrame:
    """Rows with their codes (two bytes a part) and ``error`` under the given codebooks."""
    parts, _, width = book.entries.shape
    fields = [f for f in kept.schema.fields if f.name not in (codes_name, "error")]

    def run(batches):
        for batch in _slices(batches):
            known = codes_name in batch.schema.names
            codes = _codes(batch, codes_name, parts) if known else np.zeros((batch.num_rows, parts), dtype=np.uint16)
            codes, error = assign(whole(batch.column(vector), parts * width, scale), codes, book)
            rows = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), rows, pa.array(error)], [*(f.name for f in fields), codes_name, "error"]
            )

    schema = [*fields, T.StructField(codes_name, T.BinaryType()), T.StructField("error", T.LongType())]
    return kept.mapInArrow(run, T.StructType(schema))


def sums(coded: DataFrame, entries: np.ndarray, vector: str, scale: int, codes_name: str) -> DataFrame:
    """(slot, n, radius, total): count, greatest squared distance and component sums of every used (part, entry)."""
    parts, k, width = entries.shape

    def run(batches):
        n, radius = np.zeros(parts * k, dtype=np.int64), np.zeros(parts * k, dtype=np.int64)
        total = np.zeros((parts * k, width), dtype=np.int64)
        for batch in _slices(batches):
            numbers, codes = whole(batch.column(vector), parts * width, scale), _codes(batch, codes_name, parts)
            for p in range(parts):
                x, own = numbers[:, p * width : (p + 1) * width], codes[:, p].astype(np.int64)
                slot = own + p * k
                n += np.bincount(slot, minlength=parts * k)
                np.add.at(total, slot, x)
                np.maximum.at(radius, slot, squared(x, entries[p][own]))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(n[used]), pa.array(radius[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
            ["slot", "n", "radius", "total"],
        )

    partial = coded.select(codes_name, F.col(f"`{vector}`")).mapInArrow(run, "slot long, n long, radius long, total array<long>")
    return partial.groupBy("slot").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"),
        F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"),
    )


def first_entries(kept: DataFrame, vec_id: str, vector: str, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The parts of the vectors with the least ids, at most ``entries`` of them; None without rows."""
    order = [F.col(f"`{vec_id}`").asc_nulls_last(), F.col(f"`{vector}`")]
    rows = kept.select(F.col(f"`{vec_id}`"), F.col(f"`{vector}`")).orderBy(*order).limit(entries).collect()
    if not rows:
        return None
    dims = len(rows[0][1])
    if dims % parts:
        raise ValueError(f"{parts} equal parts can't be cut from vectors of {dims} components")
    column = pa.array([[float(x) for x in r[1]] for r in rows], pa.list_(pa.float64()))
    return whole(column, dims, scale).reshape(len(rows), parts, dims // parts).transpose(1, 0, 2).copy()


def moved_entries(entries: np.ndarray, found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Entries moved to their parts' floored means, and squared radii around the old ones; unused entries stay."""
    parts, k, _ = entries.shape
    new, radii = entries.copy(), np.zeros((parts, k), dtype=np.int64)
    for r in found.collect():  # at most one row per entry of the codebooks
        p, e = divmod(r["slot"], k)
        new[p, e] = [t // r["n"] for t in r["total"]]
        radii[p, e] = r["radius"]
    return new, radii


def digest(entries: np.ndarray) -> str:
    """sha256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def fit(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE, codes_name: str = "codes",
) -> tuple[np.ndarray | None, DataFrame]:
    """The codebooks (parts, entries, width), and the kept rows with their codes and ``error`` under them."""
    kept = without(rows, codes_name, "error").where(valid(vector, zero_allowed=True))
    book = first_entries(kept, vec_id, vector, parts, entries, scale)
    if book is None:
        empty = kept.withColumns({codes_name: F.lit(None).cast("binary"), "error": F.lit(None).cast("long")})
        return None, empty
    guide = balls(book)
    for r in range(rounds):
        kept = materialize(assigned(kept, guide, vector, scale, codes_name), f"codes-{r}")
        new, radii = moved_entries(book, sums(kept, book, vector, scale, codes_name))
        guide, book = balls(new, book, radii), new
    return book, materialize(assigned(kept, guide, vector, scale, codes_name), "codes")


def code_text(codes: Column, parts: int) -> Column:
    """Entries in part order, two hexadecimal digits each (the codes hold two bytes a part, low byte first)."""
    digits = F.lower(F.hex(codes))
    low = [F.substring(digits, 4 * p + 1, 2) for p in range(parts)]
    return F.concat(*low)


def compress(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """Kept rows with ``code``, ``error``, ``label_error`` (error summed over the label) and ``codebooks_sha256``."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part, so there are 1 to 256 entries")
    base = without(rows, *(o for o in ("code", "error", "label_error", "codebooks_sha256") if o not in (vec_id, vector, label)))
    codes_name = unused(base, "_codes")
    book, coded = fit(base, vec_id, vector, parts, entries, rounds, scale, codes_name)
    per_label = coded.groupBy(F.col(f"`{label}`").alias("_label")).agg(F.sum("error").alias("label_error"))
    named = attach(coded, per_label, label, "_label", "label_error")
    return named.select(
        *[f"`{c}`" for c in base.columns], code_text(F.col(codes_name), parts).alias("code"), "error", "label_error",
        F.lit("" if book is None else digest(book)).alias("codebooks_sha256"),
    )


def decompress(spark: SparkSession, coded: DataFrame, book: np.ndarray, scale: int = SCALE, code: str = "code") -> DataFrame:
    """Add ``restored``: each vector as its entries say, in the middle of their whole-number cells."""
    parts, k, width = book.shape
    cells = [(p, f"{e:02x}", [(float(v) + 0.5) / scale for v in book[p, e]]) for p in range(parts) for e in range(k)]
    tables = F.create_map(*[x for p, e, values in cells for x in (F.lit(f"{p}:{e}"), F.array(*map(F.lit, values)))])
    pieces = [tables[F.concat(F.lit(f"{p}:"), F.substring(F.col(code), 2 * p + 1, 2))] for p in range(parts)]
    return coded.withColumn("restored", F.flatten(F.array(*pieces)))
