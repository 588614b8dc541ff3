"""What several operators share: column hygiene, text keys, word tables over Arrow buffers, connected components.

Words are found on UTF-8 bytes without making Python strings: a text column's
buffer is one byte array, a class table tells word bytes from separators, and
words are hashed eight bytes at a time, so the cost is a few numpy passes.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgrid.sources.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"  # Java and DuckDB syntax
BLOCK_BYTES = 2 << 20  # texts are worked on in blocks of about this size
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: True for word bytes, False in the given separator ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


BLANK_SEPARATED = byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))  # after lower-casing
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that clash with the given output names, in any case."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(column: str = "text"):
    """128-bit key of a text; null texts count as empty."""
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def word_count(column: str = "text"):
    """Number of blank-separated words; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give freed memory back to the system: a worker that is kept for other tasks would hold on to it."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow text column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES):
    """(first row, end row, bytes, offsets) of consecutive rows that hold about size bytes of text."""
    if batch.num_rows == 0:
        return
    data, offsets = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        end = min(max(end, first + 1), batch.num_rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list column from flat values, without a Python object a value."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


class Words(NamedTuple):
    starts: np.ndarray  # byte positions
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words at the end


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    inside = is_word[data]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


LONG_WORD = 512  # bytes; longer words are hashed one by one
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)], dtype=np.uint64)  # the bytes of a word's last, incomplete load


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of every word: eight bytes at a time are mixed in, for all words that have so many together.

    No step is linear in the bytes, so words that are each other's image under
    some pattern don't collide more often than others.
    """
    sizes = words.ends - words.starts
    out = mix(sizes.astype(np.uint64))
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    loads = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    short = np.flatnonzero(sizes <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        short = short[sizes[short] > done]
        if not len(short):
            break
        left = sizes[short] - done
        load = loads[words.starts[short] + done]
        load = np.where(left < 8, load & _TAIL[np.minimum(left, 7)], load)
        out[short] = mix(out[short] ^ mix(load))
    for i in np.flatnonzero(sizes > LONG_WORD):
        digest = hashlib.blake2b(data[words.starts[i] : words.ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, given the words' hashes."""
    out = words[n - 1 :]
    for i in range(n - 2, -1, -1):
        out = words[i : i + len(out)] * np.uint64(3) + mix(out)
    return mix(out)


def planes(x: np.ndarray) -> bytes:
    """Numbers with their bytes sorted by significance, so that high zero bytes compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()


FEW_KEYS = 100_000  # a table of this many keys and one number each is broadcast: some 5 MB
HOT_SHARE = 1000  # otherwise only keys that hold at least one in so many rows are, and there are at most so many of those


def attach(rows: DataFrame, facts: DataFrame, key: str, fact_key: str, *values: str) -> DataFrame:
    """Join one row of facts per key (null is a key) to rows, however many rows a key holds.

    Few keys are broadcast after they were counted.  Of many, the hot ones are,
    and the rest is a shuffle join, in which no key is hot.
    """
    at = unused(rows, "_at")
    # a struct of a null equals another one, so nulls meet in a plain equality join
    facts = materialize(facts.select(F.struct(F.col(f"`{fact_key}`").alias("key")).alias(at), *values), "facts")
    here = rows.withColumn(at, F.struct(F.col(f"`{key}`").alias("key")))
    if facts.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        return here.join(F.broadcast(facts), at).drop(at)
    sizes = here.groupBy(at).count()
    hot = materialize(sizes.where(F.col("count") >= max(1, here.count() // HOT_SHARE)).select(at), "hot-keys")
    crowded = here.join(F.broadcast(hot), at, "left_semi").join(F.broadcast(facts.join(F.broadcast(hot), at, "left_semi")), at)
    others = here.join(F.broadcast(hot), at, "left_anti").join(facts, at)
    return crowded.unionByName(others).drop(at)


def smallest_reachable(nodes_links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected link table: (node, root), root the least node reachable.

    Alternates two linear steps until nothing changes: every node points its
    larger neighbours at its least neighbour, then every node points its smaller
    neighbours (and itself) there.  Each round is a few aggregations and joins;
    a star with very many leaves is read as rows, never gathered.
    """
    links = materialize(
        nodes_links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links"
    )
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct()
        )
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = materialize(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star",
        )
        # every node has one smaller neighbour, and no root has one: the links are stars
        bad = small.groupBy("u").count().where("count > 1").select("u").limit(1).count()
        if not bad and not small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        links = small
