"""Substring dedup: word runs that occur more than once, found with suffix trees partitioned by prefix.

A window is ``size`` consecutive words of a text.  Every word covered by a window
that also starts somewhere else, in the same text or another, is removed; windows
are judged on the input.  All suffixes of the corpus that start with a repeated
window lie below nodes of depth ``size`` or more in its suffix tree.  The tree is
cut into subtrees that fit into memory:

1. *Prefixes.*  A window's anchor is its run of ``ANCHOR`` words with the least
   hash (the leftmost of equals), so equal windows have equal anchors at equal
   places.  The words from a window's start to its anchor's end are its prefix,
   of variable length; suffixes with one anchor end up in one group, a group
   holds whole prefixes, and no repeat crosses groups.
2. *Pruning.*  Anchors are counted over all distinct texts; one that occurs once
   has no repeated window.  A block of texts settles by itself what it holds
   twice and asks the owner of the hash range about the rest.
3. *Subtrees.*  For repeated anchors the stretch of text that its windows span is
   cut out; equal stretches are one with a count.  A task sorts the suffixes of
   its groups by prefix doubling, which yields the suffix array level by level: at
   depth ``size`` the suffixes of equal rank are the leaves of one deep internal
   node, and a node with two leaves or more is a repeat.
4. *Large groups.*  Anchors with more than ``GROUP`` different stretches get
   longer prefixes, up to the whole window, where a node's leaves are simply
   counted with partial sums before the shuffle.

Equal texts are one text, whose windows all repeat if it has several rows.

Defined results: words are blank-separated, case counts; null and blank texts
have no words, and their kept text is empty; texts shorter than the window lose
nothing; repeated rows repeat each other's windows; an empty table gives an empty
table; input columns that clash with the outputs (in any case) are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgrid.llm.common import BLANK_SEPARATED, blocks, find_words, gram_hashes, hash_words, mix, planes, text_key, unplanes, unused, without
from termgrid.sources.scratch import materialize

ANCHOR = 8
GROUP = 20_000  # stretches of one anchor that go into a subtree
STRETCHES = 25_000  # stretches of a task
ASKED_BYTES = 2 << 20  # text of a block that asks; hashing holds some 50 bytes for each of them
OUTPUT = ("n_words", "n_removed", "kept", "spans")
_SEVERAL = 1 << 31


def anchors(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, end window) of each anchor of one text, given its words' hashes."""
    width = min(ANCHOR, size)
    n = len(hashes) - size + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    grams = gram_hashes(hashes, width)
    bits = max(int(len(grams)).bit_length(), 1)
    ranked = (grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)  # ties: leftmost
    span = size - width + 1
    least, done = ranked, 1
    while done < span:  # sliding minimum by doubling
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    place = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return grams[place[begin]], place[begin], begin, np.append(begin[1:], n)


def _texts(column_bytes: np.ndarray, offsets: np.ndarray):
    words = find_words(column_bytes, offsets, BLANK_SEPARATED)
    return words, hash_words(column_bytes, words)


def ask(docs: DataFrame, size: int, parts: int, text: str) -> DataFrame:
    """Packed anchors of every text: questions by hash range, and what the block can answer by itself."""

    def run(batches):
        schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for _, _, data, offsets in blocks(batch, text, ASKED_BYTES):
                rows = ask_block(data, offsets, size, number, parts)
                number += 1
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "part int, kind int, a binary, b binary, c binary")


def ask_block(data: np.ndarray, offsets: np.ndarray, size: int, number: int, parts: int) -> list[dict]:
    words, hashes = _texts(data, offsets)
    keys: dict[bytes, int] = {}
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for i in range(len(offsets) - 1):
        own = hashes[words.first[i] : words.first[i + 1]]
        if len(own) < size:
            continue
        key = hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes()).digest()
        if key in keys:
            continue
        keys[key] = len(keys)
        found.append(anchors(own, size)[0])
        owners.append(np.full(len(found[-1]), keys[key], dtype=np.uint32))
    hashes, owner = np.concatenate(found), np.concatenate(owners)
    if not len(hashes):
        return []
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    count = np.diff(np.append(begin, len(hashes)))
    several, distinct, sent = count > 1, hashes[begin], owner[begin].copy()
    sent[several] = _SEVERAL
    inside = np.repeat(several, count)
    table = b"".join(keys)
    pairs = np.unique(np.stack([owner[inside].astype(np.uint64), hashes[inside]], axis=1), axis=0)
    place = int(mix(np.array([number], dtype=np.uint64))[0] % np.uint64(parts))
    rows = [{"part": place, "kind": 1, "a": pairs[:, 1].tobytes(), "b": pairs[:, 0].astype(np.uint32).tobytes(), "c": table}]
    edges = np.searchsorted(distinct, np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64))
    for p, (low, high) in enumerate(zip(edges, [*edges[1:], len(distinct)])):
        if high > low:
            rows.append({"part": p, "kind": 0, "a": planes(np.diff(distinct[low:high], prepend=np.uint64(0))),
                         "b": planes(sent[low:high]), "c": table})
    return rows


def _reply(keys: bytes, owner: np.ndarray, hashes: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"text_key": [keys[16 * o : 16 * o + 16] for o in owner.tolist()], "anchor": hashes.view(np.int64)})


def answer(batches):
    """(text_key, anchor) for every anchor that occurs at several places of the distinct texts."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.itertuples():
            if row.kind == 1:
                yield _reply(row.c, np.frombuffer(row.b, np.uint32), np.frombuffer(row.a, np.uint64))
            else:
                held.setdefault(row.part, []).append((row.a, row.b, row.c))
    for part in list(held):
        rows = held.pop(part)
        hashes = [np.cumsum(unplanes(a, np.uint64), dtype=np.uint64) for a, _, _ in rows]
        owners = [unplanes(b, np.uint32) for _, b, _ in rows]
        single = [np.where(o < _SEVERAL, o, 0) for o in owners]
        names = np.concatenate([np.frombuffer(c, np.uint64)[2 * s] for (_, _, c), s in zip(rows, single)])
        every, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(every, kind="stable")
        sorted_hashes, by_name = every[order], names[order]
        begin = np.flatnonzero(np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1])))
        many = np.maximum.reduceat(owner[order], begin) >= _SEVERAL
        many |= np.minimum.reduceat(by_name, begin) != np.maximum.reduceat(by_name, begin)
        repeated = np.zeros(len(every), dtype=bool)
        repeated[order] = np.repeat(many, np.diff(np.append(begin, len(every))))
        at = 0
        for (_, _, c), h, o in zip(rows, hashes, owners):
            kept = repeated[at : at + len(h)] & (o < _SEVERAL)
            at += len(h)
            if kept.any():
                yield _reply(c, o[kept], h[kept])


_STRETCH = "anchor long, stretch binary, windows int, text_key binary, start int, stretch_key binary"


def cut_stretches(size: int):
    """For rows (text_key, text, repeated): the words that each repeated anchor's windows span.

    A copy that follows its like is passed over: it has the same stretches at the same places.
    """

    def run(batches):
        last = None
        for batch in batches:
            if not len(batch):
                continue
            before = batch["text_key"].shift(fill_value=last if last is not None else b"")
            last = batch["text_key"].iloc[-1]
            batch = batch[batch["text_key"] != before]
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                raw = [t.encode() for t in some["text"]]
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
                words, hashes = _texts(data, offsets)
                out = []
                for i, (key, text, repeated) in enumerate(zip(some["text_key"], raw, some["repeated"])):
                    found, _, begin, end = anchors(hashes[words.first[i] : words.first[i + 1]], size)
                    own = text.split()
                    kept = np.flatnonzero(np.isin(found.view(np.int64), repeated))
                    for k in kept.tolist():
                        a, b = int(begin[k]), int(end[k])
                        stretch = b" ".join(own[a : b + size - 1])
                        out.append((int(found[k].view(np.int64)), stretch, b - a, key, a, hashlib.md5(stretch).digest()))
                yield pd.DataFrame(out, columns=["anchor", "stretch", "windows", "text_key", "start", "stretch_key"])

    return run


def deep_nodes(stretches: list[list[int]], counts: np.ndarray, size: int) -> list[np.ndarray]:
    """For each stretch (word numbers) the windows that are leaves of a node with several leaves.

    Ranks of ever longer prefixes, in order, by prefix doubling; a window's rank
    names its node at depth ``size``.
    """
    lengths = np.array([len(s) for s in stretches], dtype=np.int64)
    rank = np.concatenate([np.array(s, dtype=np.int64) for s in stretches]) if len(stretches) else np.zeros(0, np.int64)
    rank = np.append(rank, np.zeros(size, np.int64))
    depth = 1

    def deepen(step: int) -> np.ndarray:
        pair = rank[: len(rank) - step] * np.int64(int(rank.max()) + 1) + rank[step:]
        return np.append(np.unique(pair, return_inverse=True)[1], np.zeros(step, np.int64))

    while 2 * depth <= size:
        rank, depth = deepen(depth), 2 * depth
    if depth < size:
        rank = deepen(size - depth)
    first = np.concatenate(([0], np.cumsum(lengths)))
    windows = np.maximum(lengths - size + 1, 0)
    places = np.repeat(first[:-1], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    node = rank[places]
    leaves = np.bincount(node, weights=np.repeat(counts, windows), minlength=1)
    return np.split(leaves[node] > 1, np.cumsum(windows)[:-1]) if len(stretches) else []


def subtrees(size: int):
    """(stretch_key, mask): for each stretch a bit for every window that repeats."""

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        numbers: dict[bytes, int] = {}
        stretches = [[numbers.setdefault(w, len(numbers)) for w in s.split(b" ")] for s in rows["stretch"]]
        found = deep_nodes(stretches, rows["n"].to_numpy(), size)
        masks = [np.packbits(f, bitorder="little").tobytes() for f in found]
        keep = [bool(f.any()) for f in found]
        yield pd.DataFrame({"stretch_key": rows["stretch_key"], "mask": masks})[keep]

    return run


def repeated_windows(docs: DataFrame, size: int, text: str, group: int = GROUP) -> DataFrame:
    """(text_key, hits): for each text with repeated windows, structs of a start word and a bit mask of windows from there."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(4, parts // 4)  # anchors are few against words, and each question carries its block's text keys
    asked = ask(docs, size, ranges, text).repartition(ranges, "part")
    repeated = asked.mapInPandas(answer, "text_key binary, anchor long")
    by_text = repeated.groupBy("text_key").agg(F.collect_list("anchor").alias("repeated"))
    texts = docs.select(F.unhex(text_key(text)).alias("text_key"), F.col(text).alias("text")).where("text is not null")
    # copies of a text meet its anchors too; most are passed over, and the distinct below makes the rest one
    cut = texts.join(by_text, "text_key").mapInPandas(cut_stretches(size), _STRETCH)
    cut = materialize(cut, "stretches")
    places = cut.select("text_key", "start", "stretch_key", "windows").distinct()
    n = cut.count()
    whole = cut.groupBy("anchor", "stretch_key").agg(F.first("stretch").alias("stretch"), F.first("windows").alias("windows"))
    counted = places.groupBy("stretch_key").agg(F.count("*").alias("n"))
    whole = materialize(whole.join(counted, "stretch_key"), "stretch-counts")
    large = whole.groupBy("anchor").count().where(F.col("count") > group).select("anchor")
    small = whole.join(large, "anchor", "left_anti").repartition(max(parts, -(-n // STRETCHES)), "anchor")
    masks = small.select("stretch_key", "stretch", "n").mapInPandas(subtrees(size), "stretch_key binary, mask binary")
    # longer prefixes: whole windows of the large groups, counted
    words = F.split(F.col("stretch").cast("string"), " ")
    windows = whole.join(large, "anchor", "left_semi").select(
        "stretch_key", "n", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.col("windows") - 1), lambda i: F.md5(F.concat_ws(" ", F.slice(words, i + 1, F.lit(size))).cast("binary"))
        )).alias("at", "window"),
    )
    nodes = windows.groupBy("window").agg(F.sum("n").alias("leaves")).where("leaves > 1").select("window")
    deep = windows.join(nodes, "window", "left_semi").select("stretch_key", "at")
    hits = places.join(masks, "stretch_key").select("text_key", "start", "mask").unionByName(
        places.join(deep, "stretch_key").select("text_key", (F.col("start") + F.col("at")).alias("start"), F.lit(b"\x01").alias("mask"))
    )
    return hits.groupBy("text_key").agg(F.collect_list(F.struct("start", "mask")).alias("hits"))


def dedup_substrings(docs: DataFrame, text: str = "text", size: int = 35, group: int = GROUP) -> DataFrame:
    """Add n_words, n_removed, kept (the kept words, joined by one blank) and spans (removed [start, end) in words)."""
    base = without(docs, *(o for o in OUTPUT if o != text))
    key, hit_, many = (unused(base, c) for c in ("_key", "_hits", "_rows"))
    keyed = base.withColumn(key, F.unhex(text_key(text)))
    copies = keyed.groupBy(key).count().where("count > 1").select(key, F.lit(True).alias(many))
    hits = repeated_windows(base, size, text, group).select(F.col("text_key").alias(key), F.col("hits").alias(hit_))
    per_text = copies.join(hits, key, "full")
    added = T._parse_datatype_string(
        "n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>").fields
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    kept_columns = base.columns

    def run(batches):
        for batch in batches:
            for first, end, _, _ in blocks(batch, text):
                rows = batch.slice(first, end - first)
                found = [
                    remove((raw or "").encode(), hit, bool(copied), size)
                    for raw, hit, copied in zip(*(rows.column(c).to_pylist() for c in (text, hit_, many)))
                ]
                columns = [*(rows.column(c) for c in kept_columns), *(pa.array(c, k) for c, k in zip(zip(*found), kinds))]
                yield pa.RecordBatch.from_arrays(columns, [*kept_columns, *OUTPUT])

    joined = keyed.join(per_text, key, "left").drop(key)
    return joined.mapInArrow(run, T.StructType([*base.schema.fields, *added]))


def remove(raw: bytes, hits, copied: bool, size: int):
    words = raw.split()
    n = len(words)
    repeated = np.zeros(n + 1, dtype=np.int64)
    if n >= size and copied:
        repeated[0], repeated[n] = 1, -1
    elif hits is not None and len(hits):
        starts = np.concatenate([
            h["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(h["mask"], np.uint8), bitorder="little")) for h in hits
        ])
        np.add.at(repeated, starts, 1)
        np.add.at(repeated, starts + size, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    if not covered.any():
        return n, 0, b" ".join(words).decode(), []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
    kept = b" ".join([w for w, c in zip(words, covered.tolist()) if not c]).decode()
    return n, int(covered.sum()), kept, spans
