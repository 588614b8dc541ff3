"""Integrity of append-only event logs with a hash chain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO_HASH = "0" * 64


def content_hash(columns: Sequence[str]) -> Column:
    """sha256 of the columns as text, joined by ``|``; null counts as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


PIECE = 4096  # events of a log that one task folds


def _fold(moves: Mapping[str, str], allowed: Mapping[str, Sequence[str]], names: Sequence[str], events: Column) -> Column:
    """The transition function of a run of actions: for every state before, (state after, illegal actions)."""
    to = F.create_map(*[F.lit(x) for pair in moves.items() for x in pair]).cast("map<string,string>")
    sources = F.create_map(*[x for a, f in allowed.items() for x in (F.lit(a), F.array(*map(F.lit, f)))]).cast("map<string,array<string>>")

    def step(at: Column, event: Column) -> Column:
        known = sources[event["action"]]
        wrong = F.coalesce(known.isNotNull() & ~F.array_contains(known, at["state"]), F.lit(False))
        return F.struct(
            F.coalesce(to[event["action"]], at["state"]).alias("state"), (at["illegal"] + wrong.cast("long")).alias("illegal"))

    return F.transform(F.array(*map(F.lit, names)), lambda before: F.aggregate(
        events, F.struct(before.alias("state"), F.lit(0).cast("long").alias("illegal")), step))


def derived_states(
    events: DataFrame, moves: Mapping[str, str], allowed: Mapping[str, Sequence[str]], initial: str, log: str = "log_id", sequence: str = "sequence",
) -> DataFrame:
    """(log, status, illegal): where a log's actions lead, and how many came in a state that doesn't allow them.

    A log is cut into pieces of ``PIECE`` sequence numbers.  Each piece is folded
    into a function of the state before it, and these small functions are composed
    in order, so a log that holds half of all events is the work of many tasks.
    """
    names = list(dict.fromkeys([initial, *moves.values()]))
    ordered = F.array_sort(F.collect_list(F.struct(sequence, "action")))
    pieces = events.groupBy(log, F.floor(F.col(sequence) / PIECE).alias("piece")).agg(ordered.alias("found"))
    pieces = pieces.select(log, "piece", _fold(moves, allowed, names, F.col("found")).alias("after"))
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])

    def compose(at: Column, piece: Column) -> Column:
        one = F.get(piece["after"], place[at["state"]])
        return F.struct(one["state"].alias("state"), (at["illegal"] + one["illegal"]).alias("illegal"))

    start = F.struct(F.lit(initial).alias("state"), F.lit(0).cast("long").alias("illegal"))
    whole = pieces.groupBy(log).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("piece", "after"))), start, compose).alias("end"))
    return whole.select(log, F.col("end.state").alias("status"), F.col("end.illegal").alias("illegal"))


def verify_logs(
    events: DataFrame, hashed: Sequence[str], states: Mapping[str, str], initial: str = "planned",
    log: str = "log_id", sequence: str = "sequence", allowed: Mapping[str, Sequence[str]] | None = None,
    stored: DataFrame | None = None, counted: str | None = None,
) -> DataFrame:
    """One row per log: contiguous sequence, intact links and hashes, derived against stored state.

    ``allowed`` lists the states in which an action may come; ``stored`` has the
    log's ``status`` and ``attempts`` as its owner projects them, and ``counted``
    is the action that is an attempt.  The link to the previous event is an
    equi-join on (log, sequence), so a log that holds a large part of all events is
    still spread over all tasks.
    """
    previous = events.select(
        F.col(log).alias("_log"), (F.col(sequence) + 1).alias("_sequence"), F.col("event_hash").alias("_expected"),
    ).groupBy("_log", "_sequence").agg(F.min("_expected").alias("_expected"))
    rows = events.join(previous, (F.col(log) == F.col("_log")) & (F.col(sequence) == F.col("_sequence")), "left")
    expected = F.when(F.col(sequence) == 1, F.lit(ZERO_HASH)).otherwise(F.col("_expected"))
    # First per sequence number, so repeated numbers show up as rows > distinct numbers.
    per_number = rows.groupBy(log, sequence).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("prev_hash").eqNullSafe(expected)).alias("bad_links"),
        F.count_if(~F.col("event_hash").eqNullSafe(content_hash(hashed))).alias("bad_hashes"),
        F.count_if(F.col("action") == F.lit(counted)).alias("attempts"), F.max("event_hash").alias("hash"),
    )
    grouped = per_number.groupBy(log).agg(
        F.sum("rows").alias("events"), F.count(F.lit(1)).alias("numbers"),
        F.min(sequence).alias("first"), F.max(sequence).alias("last"),
        F.sum("bad_links").alias("bad_links"), F.sum("bad_hashes").alias("bad_hashes"),
        F.sum("attempts").alias("attempts"), F.max_by("hash", sequence).alias("head_hash"),
    )
    grouped = grouped.join(derived_states(events, states, allowed or {}, initial, log, sequence), log)
    if stored is not None:
        projected = stored.select(log, F.col("status").alias("stored_status"), F.col("attempts").alias("stored_attempts"))
        grouped = grouped.join(projected, log, "left")
        agrees = F.col("stored_status").eqNullSafe(F.col("status")) & F.col("stored_attempts").eqNullSafe(F.col("attempts"))
    else:
        grouped = grouped.withColumn("stored_status", F.lit(None).cast("string"))
        agrees = F.lit(True)
    contiguous = (
        (F.col("first") == 1) & (F.col("last") == F.col("numbers")) & (F.col("events") == F.col("numbers"))
    )
    return grouped.select(
        log, "events", contiguous.alias("contiguous"), "bad_links", "bad_hashes", "illegal", "attempts", "status", "stored_status",
        agrees.alias("agrees"), "head_hash",
        (contiguous & (F.col("bad_links") == 0) & (F.col("bad_hashes") == 0) & (F.col("illegal") == 0) & agrees).alias("ok"),
    )
