"""N-gram Jaccard join: documents whose sets of word n-grams are similar, exactly, by prefix filters in several orders.

Two sets of similarity at least t share a token among the first
``n - ceil(t n) + 1`` tokens of each, in any global order of tokens.  Here the
orders are by document frequency (in powers of two), rare first, and within a
frequency by three independent hashes.  Candidates must share prefix tokens
under all three; what passes the intersection is verified on the whole sets.

1. *Frequencies.*  Blocks of documents send each distinct token once, packed, to
   the task that owns its hash range; a token that many documents of a block
   hold is one entry.  The owners answer which tokens more than one distinct set
   holds, and their frequency.  A token of a single set can't be shared, so a set
   with more such tokens than t allows to differ has no link at all; with prose
   and its copies few sets are left, near copies with many edits included.
2. *Classes.*  Equal sets are one class, whatever their number.
3. *Stars.*  In each bucket (a token of order one's prefixes) all sets meet only
   the one with the fewest unshared tokens.  Verified links join classes into
   components.
4. *The rest.*  Only buckets that still hold several components are joined with
   themselves, and only pairs of different components that share a prefix token
   in every order, meet at their first common one, and whose parity bitmaps differ
   in no more bits than t allows tokens to differ, are verified.  No pair inside a component is ever made, and no
   link between components is lost.

``links`` gives every link between classes instead, by step 4 for all pairs.

Defined results: words are blank-separated after A-Z are lower-cased; a text
with fewer words than n is one token, its whole sequence; null and blank texts
have an empty set and no links; repeated rows and ids are documents of their
own; a null id is never a component's id unless all ids in it are null; an empty
table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgrid.llm.common import (
    BLANK_SEPARATED, LOWER, blocks, find_words, gram_hashes, hash_words, mix, planes, release, smallest_reachable, unplanes,
)
from termgrid.sources.scratch import materialize

PACKED_BYTES = 4 << 20  # text in a block
SEVERAL = 1 << 31  # owner numbers from here on are counts of owners
RANGE_BYTES = 32 << 20  # text whose tokens a hash range holds, so that a task's memory doesn't grow with the table
BITMAPS = 8  # longs of the parity bitmap
ORDERS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))

_PACKED = "part int, block long, kind int, a binary, b binary, c binary"
_SETS = (
    "doc_id long, n_shingles long, class string, shared long, " + "".join(f"bits{k} long, " for k in range(BITMAPS))
    + "order1 array<long>, order2 array<int>, order3 array<int>, tokens binary"
)
_BITS = [f"bits{k}" for k in range(BITMAPS)]


def text_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct token hashes of each text."""
    lowered = LOWER[data]
    words = find_words(lowered, offsets, BLANK_SEPARATED)
    hashes = hash_words(lowered, words)
    out = []
    for first, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        own = hashes[first:end]
        if len(own) >= n:
            own = gram_hashes(own, n)
        elif len(own):
            own = gram_hashes(own, len(own))
        out.append(np.unique(own))
    return out


def set_name(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        return int(mix(tokens).sum(dtype=np.uint64)), int(mix(tokens ^ ORDERS[0]).sum(dtype=np.uint64))


def parity(tokens: np.ndarray) -> list[int]:
    """A bitmap with a bit set where an odd number of tokens falls: two sets differ in at least as many tokens as bitmaps in bits."""
    odd = np.bincount((mix(tokens) % np.uint64(64 * BITMAPS)).astype(np.int64), minlength=64 * BITMAPS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def pack(docs: DataFrame, doc_id: str, text: str, n: int, parts: int) -> DataFrame:
    def run(batches):
        number = TaskContext.get().partitionId() << 24  # mixed before it says where the block's own table goes
        for batch in batches:
            for first, end, data, offsets in blocks(batch, text, PACKED_BYTES):
                rows = pack_block(batch.column(doc_id).slice(first, end - first).to_pylist(), text_sets(data, offsets, n), number, parts)
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()),
                ]))
                number += 1
        release()

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).cast("string").alias(text)).mapInArrow(run, _PACKED)


def pack_block(ids: list, sets: list[np.ndarray], number: int, parts: int) -> list[dict]:
    names = [set_name(s) for s in sets]
    lead: dict[tuple[int, int], int] = {}  # the first document with each set stands for it
    for i, name in enumerate(names):
        lead.setdefault(name, i)
    own = [sets[i] for i in lead.values()]
    tokens = np.concatenate([*own, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(own), dtype=np.uint32), [len(s) for s in own])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((begin, [len(tokens)])))
    distinct, sent = tokens[begin], owner[begin].copy()
    several = count > 1
    sent[several] = SEVERAL + count[several]
    inside = np.repeat(several, count)
    table = (ids, [len(s) for s in sets], names, list(lead.values()))
    lists = (
        planes(np.diff(distinct[several], prepend=np.uint64(0))), planes(count[several].astype(np.uint32)), planes(owner[inside]),
    )
    place = int(mix(np.array([number], dtype=np.uint64))[0] % np.uint64(parts))
    rows = [{"part": place, "block": number, "kind": 1, "a": pickle.dumps(table), "b": pickle.dumps(lists), "c": b""}]
    named = np.array([names[i][0] for i in lead.values()], dtype=np.uint64)
    edges = np.searchsorted(distinct, np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)).tolist() + [len(distinct)]
    for p in range(parts):
        here, by = distinct[edges[p] : edges[p + 1]], sent[edges[p] : edges[p + 1]]
        if len(here):
            rows.append({
                "part": p, "block": number, "kind": 0, "a": planes(np.diff(here, prepend=np.uint64(0))),
                "b": planes(by), "c": named[np.unique(by[by < SEVERAL])].tobytes(),
            })
    return rows


def answer(batches):
    """For each hash range: which tokens more than one set holds, and the power of two of their frequency."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.itertuples():
            if row.kind == 1:
                yield pd.DataFrame({"block": [row.block], "kind": [1], "a": [row.a], "b": [row.b], "c": [row.c]})
            else:
                held.setdefault(row.part, []).append((row.block, row.a, row.b, row.c))
    for part in list(held):  # one range, unless the hash range's partition was merged with others
        yield from answer_range(held.pop(part))
        release()


def answer_range(rows: list) -> list[pd.DataFrame]:
    sizes = [len(b) // 4 for _, _, b, _ in rows]
    edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
    token, owner, name = (np.empty(edges[-1], dtype=t) for t in (np.uint64, np.uint32, np.uint64))
    for (_, a, b, c), low, high in zip(rows, edges, edges[1:]):
        np.cumsum(unplanes(a, np.uint64), out=token[low:high])
        owner[low:high] = o = unplanes(b, np.uint32)
        known = np.concatenate((np.frombuffer(c, np.uint64), np.zeros(1, np.uint64)))  # of the single owners in order, then a spare
        name[low:high] = known[np.where(o < SEVERAL, np.searchsorted(np.unique(o[o < SEVERAL]), o), len(known) - 1)]
    order = np.argsort(token, kind="stable")
    ordered = token[order]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    del ordered
    name = name[order]
    many = np.minimum.reduceat(name, begin) != np.maximum.reduceat(name, begin)
    del name
    by = owner[order]
    many |= np.maximum.reduceat(by, begin) >= SEVERAL
    frequency = np.add.reduceat(np.where(by >= SEVERAL, by - SEVERAL, 1).astype(np.int64), begin)
    del by
    power = np.where(many, np.floor(np.log2(frequency)).astype(np.uint8) + 1, 0).astype(np.uint8)
    level = np.zeros(len(token), dtype=np.uint8)
    level[order] = np.repeat(power, np.diff(np.append(begin, len(token))))
    del order
    out = []
    for (block, _, _, _), low, high in zip(rows, edges, edges[1:]):
        own = level[low:high]
        kept = own > 0
        if kept.any():
            out.append(pd.DataFrame({
                "block": [block], "kind": [0], "a": [planes(np.diff(token[low:high][kept], prepend=np.uint64(0)))],
                "b": [planes(owner[low:high][kept])], "c": [own[kept].tobytes()],
            }))
    return out


def rebuild(batches, percent: int):
    """Documents with their shared tokens and prefixes, block by block."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.itertuples():
            held.setdefault(row.block, []).append((row.kind, row.a, row.b, row.c))
    for block in list(held):
        rows = held.pop(block)
        tokens, owners, levels = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for kind, a, b, c in rows:
            if kind == 1:
                (ids, sizes, names, lead), (listed, count, docs) = pickle.loads(a), pickle.loads(b)
                listed = np.cumsum(unplanes(listed, np.uint64), dtype=np.uint64)
                count, docs = unplanes(count, np.uint32), unplanes(docs, np.uint32)
            else:
                tokens.append(np.cumsum(unplanes(a, np.uint64), dtype=np.uint64))
                owners.append(unplanes(b, np.uint32).astype(np.int64))
                levels.append(np.frombuffer(c, np.uint8))
        token, owner, level = map(np.concatenate, (tokens, owners, levels))
        wide = owner >= SEVERAL  # every token of the block's lists is answered, in any order
        order = np.argsort(token[wide])
        token = np.concatenate((token[~wide], np.repeat(listed, count)))
        level = np.concatenate((level[~wide], np.repeat(level[wide][order], count)))
        owner = np.concatenate((owner[~wide], docs.astype(np.int64)))
        order = np.lexsort((token, owner))
        token, level, owner = token[order], level[order], owner[order]
        edges = np.searchsorted(owner, np.arange(len(lead) + 1))
        first_of = {doc: k for k, doc in enumerate(lead)}
        out = []
        for i, (doc, size, name) in enumerate(zip(ids, sizes, names)):
            row = [doc, size, f"{name[0]:016x}{name[1]:016x}" if size else None, None, *[None] * BITMAPS, None, None, None, None]
            if i in first_of and size:
                t, w = (x[edges[first_of[i]] : edges[first_of[i] + 1]] for x in (token, level))
                prefix = size - (percent * size + 99) // 100 + 1 - (size - len(t))
                if prefix > 0:
                    row[3] = len(t)
                    row[4 : 4 + BITMAPS] = parity(t)
                    for k, salt in enumerate(ORDERS, 4 + BITMAPS):
                        row[k] = t[np.lexsort((mix(t ^ salt), w))[:prefix]].astype(np.int64)
                        if k > 4 + BITMAPS:  # what only filters may be shorter: equal tokens stay equal
                            row[k] = row[k].astype(np.int32)
                    row[7 + BITMAPS] = planes(np.diff(t, prepend=np.uint64(0)))
            out.append(row)
        for start in range(0, len(out), 1000):
            # as objects first: a column of numbers and None would become floats, which hold 53 bits
            yield pd.DataFrame(out[start : start + 1000], dtype=object, columns=[
                "doc_id", "n_shingles", "class", "shared", *_BITS, "order1", "order2", "order3", "tokens",
            ]).astype(dict.fromkeys(["doc_id", "n_shingles", "shared", *_BITS], "Int64"))


def document_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """A row for each document: set size, class, and, where a link is possible, shared tokens and prefixes."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    packed = pack(docs, doc_id, text, n, parts).repartitionById(parts, "part")
    answered = packed.mapInPandas(answer, "block long, kind int, a binary, b binary, c binary").repartition(parts, "block")
    return materialize(answered.mapInPandas(lambda b: rebuild(b, percent), _SETS), "jaccard-sets")


def _similar(both, n_a, n_b, percent: int):
    return 100 * both >= percent * (n_a + n_b - both)


def verify(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the candidate pairs (a, b) whose whole sets are similar."""
    sets = classes.select("class", "n_shingles", "tokens")

    def run(batches):
        for batch in batches:
            keep = []
            for n_a, n_b, x, y in zip(batch["n_a"], batch["n_b"], batch["x"], batch["y"]):
                both = len(np.intersect1d(*(np.cumsum(unplanes(raw, np.uint64)) for raw in (x, y)), assume_unique=True))
                keep.append(_similar(both, n_a, n_b, percent))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    left = pairs.join(sets.select(F.col("class").alias("a"), F.col("n_shingles").alias("n_a"), F.col("tokens").alias("x")), "a")
    return left.join(
        sets.select(F.col("class").alias("b"), F.col("n_shingles").alias("n_b"), F.col("tokens").alias("y")), "b"
    ).mapInPandas(run, "a string, b string")


def candidates(classes: DataFrame, percent: int, components: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, that pass the filters of all orders; with components, only pairs of different ones."""
    thin = classes.select("class", F.explode("order1").alias("token"))
    if components is None:
        thin = thin.withColumn("root", F.col("class"))
    else:
        thin = thin.join(components.withColumnRenamed("node", "class"), "class", "left")
        thin = thin.withColumn("root", F.coalesce("root", "class"))
    mixed = thin.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
    open_rows = thin.join(mixed, "token", "left_semi")
    rows = open_rows.join(classes.drop("tokens"), "class")
    a = rows.select([F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = rows.select([F.col(c).alias(f"b_{c}") for c in rows.columns])
    least = F.least("a_shared", "b_shared")
    unshared = F.col("a_n_shingles") - F.col("a_shared") + F.col("b_n_shingles") - F.col("b_shared")
    apart = unshared + sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _BITS)
    total = F.col("a_n_shingles") + F.col("b_n_shingles")
    return a.join(b, (
        (F.col("a_token") == F.col("b_token")) & (F.col("a_class") < F.col("b_class")) & (F.col("a_root") != F.col("b_root"))
        & _similar(least, F.col("a_n_shingles"), F.col("b_n_shingles"), percent)
        & ((100 + percent) * apart <= (100 - percent) * total)
        & (F.element_at(F.array_intersect("a_order1", "b_order1"), 1) == F.col("a_token"))
        & F.arrays_overlap("a_order2", "b_order2") & F.arrays_overlap("a_order3", "b_order3")
    )).select(F.col("a_class").alias("a"), F.col("b_class").alias("b"))


def stars(classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of each bucket's set with the fewest unshared tokens and every other one, filters passed."""
    rows = classes.select("class", (F.col("shared") / F.col("n_shingles")).alias("part"), F.explode("order1").alias("token"))
    best = rows.groupBy("token").agg(F.max(F.struct("part", "class")).alias("best"), F.count("*").alias("n")).where("n > 1")
    pairs = rows.join(best, "token").where(F.col("class") != F.col("best.class")).select(
        F.least("class", "best.class").alias("a"), F.greatest("class", "best.class").alias("b")).distinct()
    orders = classes.select("class", "order2", "order3")
    pairs = pairs.join(orders.select(F.col("class").alias("a"), F.col("order2").alias("a2"), F.col("order3").alias("a3")), "a")
    pairs = pairs.join(orders.select(F.col("class").alias("b"), F.col("order2").alias("b2"), F.col("order3").alias("b3")), "b")
    return pairs.where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")


def class_table(sets: DataFrame) -> DataFrame:
    """One row for each class that may have links (equal sets carry equal rows)."""
    return materialize(sets.where("tokens is not null").drop("doc_id").dropDuplicates(["class"]), "jaccard-classes")


def links(sets: DataFrame, percent: int = 90) -> DataFrame:
    """Every link (a, b) between different classes; members are the rows of ``sets`` with those classes."""
    classes = class_table(sets)
    return verify(candidates(classes, percent), classes, percent)


def components(sets: DataFrame, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, class, component_id) of every document."""
    classes = class_table(sets)
    near = materialize(verify(stars(classes), classes, percent), "jaccard-stars")
    roots = smallest_reachable(near)
    more = materialize(verify(candidates(classes, percent, roots), classes, percent), "jaccard-rest")
    if more.limit(1).count():
        roots = smallest_reachable(near.unionByName(more))
    named = sets.select("doc_id", "n_shingles", "class").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("component", F.coalesce("root", "class"))
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component", "left").select(
        "doc_id", "n_shingles", "class", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    return components(document_sets(docs, doc_id, text, n, percent), percent)
