"""Packing against a version that packs piece by piece, and the query's columns against the tokenizer itself."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termgrid.llm import packing, queries

VOCABULARY = public_tokenizers.path(queries.VOCABULARY)


def piece_by_piece(lengths, capacity, rule):
    """Sequences as lists of lengths, filled one piece at a time, and the orders' tie rule: earlier runs first."""
    limits = capacity.limits()
    items = [np.array([n, 1, n * n]) for n in sorted(lengths, reverse=True)]
    loads = sum(items) / limits
    weights = loads / loads.sum()
    left, bins = [], []
    for item in items:
        best = None
        for k, r in enumerate(left):
            if (r >= item).all():
                if rule == "norm":
                    score = -(weights * ((r - item) / limits) ** 2).sum()
                else:
                    score = (weights * (item / limits) * (r / limits)).sum()
                if best is None or score > best[0] + 1e-15:
                    best = (score, k)
        if best is None:
            left.append(limits.copy())
            bins.append([])
            best = (0, len(bins) - 1)
        left[best[1]] -= item
        bins[best[1]].append(int(item[0]))
    return bins


def follow(orders, histogram, capacity):
    """Sequences as the orders fill them; every piece is placed once, gapless and under every capacity."""
    placed = defaultdict(list)
    for length, n in histogram.items():
        mine = sorted(o for o in orders if o.length == length)
        assert [o.first for o in mine] + [n] == [0] + [o.end for o in mine]
        for o in mine:
            for i in range(o.end - o.first):
                placed[o.sequence + i // o.each].append((o.offset + i % o.each * length, length))
    for found in placed.values():
        ends = np.cumsum([n for _, n in sorted(found)])
        assert [at for at, _ in sorted(found)] == [0, *ends[:-1]]
        load = np.array([ends[-1], len(found), sum(n * n for _, n in found)])
        assert (load <= capacity.limits()).all()
    return placed


@pytest.mark.parametrize("capacity", [packing.Capacity(64), packing.Capacity(64, 3), packing.Capacity(64, 8, 4200), packing.Capacity(64, None, 4096)])
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_orders_follow_the_packing_of_single_pieces(capacity, rule):
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 65, 300), rng.integers(1, 9, 200), [64] * 20 + [1] * 7, rng.choice([33, 31, 17, 16], 150), [5]):
        histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
        orders, sequences = packing.pack_lengths(histogram, capacity, rule)
        placed = follow(orders, histogram, capacity)
        assert sorted(placed) == list(range(sequences))
        plain = piece_by_piece([int(n) for n in lengths], capacity, rule)
        if rule == "norm":  # ties between equally good runs may fall otherwise, so contents can differ a little
            assert abs(len(plain) - sequences) <= max(1, len(plain) // 50)
        assert sequences >= -(-int(np.sum(lengths)) // capacity.tokens)


def test_counts_grow_without_more_orders():
    histogram = {int(n): 10**9 + int(n) for n in range(1, 1025, 3)}
    orders, sequences = packing.pack_lengths(histogram, packing.Capacity(1024))
    total = sum(n * c for n, c in histogram.items())
    assert len(orders) < 20_000 and sequences <= 1.002 * total / 1024


def test_capacities_are_checked():
    for bad in (packing.Capacity(0), packing.Capacity(8, 0), packing.Capacity(8, 2, 63)):
        with pytest.raises(ValueError):
            packing.pack_lengths({1: 1}, bad)
    assert packing.pack_lengths({}, packing.Capacity(8)) == ([], 0)


def test_cut_points():
    assert packing.cut_points(5, 4) == [0, 1, 5] and packing.cut_points(8, 4) == [0, 4, 8] and packing.cut_points(4, 4) == [0, 4]
    assert packing.cut_points(1, 4) == [0, 1]


def brute_pieces(docs, tokens=1024):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    out = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % tokens or tokens, len(ids) + 1, tokens)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc_id, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])), ids[a:b]))
    return sorted(out, key=str)


def test_query_and_sequences(spark, tmp_path):
    rows = [(i, f"{'word ' * (i * 37 % 500)} tail {i}", "w") for i in range(60)]
    rows += [(100, None, "w"), (101, "", "w"), (101, "", "w"), (102, "x" * 1_000_000, "w"), (103, "a b " * 6000, "w"), (None, "no id", "w"), (104, "q " * 1023, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, OFFSET string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op13_packing"](spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    want = brute_pieces([(i, t) for i, t, _ in rows])
    found = got.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == sorted((w[:5] for w in want), key=str)
    members = defaultdict(list)
    for r in found:
        members[r.sequence_id].append((r.offset, r.length))
    for found in members.values():
        ends = np.cumsum([n for _, n in sorted(found)])
        assert [at for at, _ in sorted(found)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(members) <= 1.03 * sum(w[3] for w in want) / 1024 + 1

    packed = packing.pack(docs, VOCABULARY, packing.Capacity(64, 3), ids=True)
    assert "OFFSET" not in packed.columns and "text" not in packed.columns
    pieces = packed.collect()
    assert max(sum(1 for r in pieces if r.sequence_id == s) for s in {r.sequence_id for r in pieces}) <= 3
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(joined[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in pieces)
    assert sorted(map(str, (r.ids for r in pieces))) == sorted(str(w[5]) for w in brute_pieces([(i, t) for i, t, _ in rows], 64))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, extra int")
    out = packing.pack(docs, VOCABULARY)
    assert out.count() == 0 and out.columns == ["doc_id", "extra", *packing.OUTPUTS]


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (2, "c", None)], "doc_id long, text string, _rank int")
    out = packing.pack(docs.withColumn("other", F.lit("x")), VOCABULARY)
    assert {r.other for r in out.collect()} == {"x"}
