"""Conversation structure repair: the cheapest edits that give alternating turns, found by iterative-deepening A*.

A repaired conversation has the roles ``(system? (user assistant)+)?``, judged by
their initials.  Its rows are kept (0), given the role that is due (2) or deleted
(3; blank rows and repeats must be), and empty rows of the due role are inserted
(2); a row that breaks off and stays adds 1.  Of the cheapest edit lists the one
whose initials (D, I, K, R) come first in ASCII order is the answer.

*Search.*  States are (rows consumed, last role given).  A depth-first search
tries the edits in ASCII order within a cost bound, and the bound rises to the
least cost at which something was cut off, so the first accepting path is the
answer.  Two things keep it short.  What the rows from here on cost at least, each
by itself and in disjoint pairs that can't stand side by side, is known before the
search.  And a table holds every state that failed, with the least budget that
may still succeed; it is kept from one bound to the next.

*Long conversations* are cut in segments of ``SEGMENT`` rows, which are searched
from each role before to each role after, in parallel; a conversation then needs
only their 16 costs and the order of their paths to choose among them.  An insert
belongs to the row behind it, so paths of one segment are never prefixes of each
other, and choosing segment by segment gives the first path of all.

*What moves.*  Rows are judged where they are read.  The numbering and the search
see a few bytes a row, without texts; texts are shuffled once, sorted, and
rewritten or hashed as they stream by, so the memory for a conversation is a letter
a row.  A conversation's hash is a sequential function of all its texts, so they
pass through one task.

Defined results: rows are taken by turn, nulls first, rows of one turn by role and
then a hash of the text; a null role or text counts as one blank, an empty role
has no initial and fits anywhere; other initials never fit.  A null conversation
id is a conversation of its own.  Conversations without rows are the caller's:
``summarize`` lists every id it is given.  An empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from termgrid.sources.scratch import materialize

BLANKS = " \t\n\x0b\x0c\r"
SEGMENT = 256
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}
EDITS = "DIKR"
BROKEN_OFF = 1
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)  # the role due in each state, and the state after it
ROLES = {USER: "user", ASSISTANT: "assistant"}
FITS = {
    "s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {},
    "e": {s: s for s in range(4)},
}
LEGAL = {"su", "ua", "au", "a$"}
IMPOSSIBLE = 1 << 40
DELETED = "D"  # code of a row that must go; others are s, u, a, x (another role), e (none), in capitals if they break off


def at_least(codes: str, last: bool, goals: tuple[int, ...] = (START, ASSISTANT), start: int = START) -> list[int]:
    """What the rows from each place on cost at least on the way to the goals."""
    out = [0] * (len(codes) + 1)
    if not last and goals in ((START,), (SYSTEM,)):  # before the first turn: all rows with a role go, but for one system row
        for i in range(len(codes) - 1, -1, -1):
            out[i] = out[i + 1] + (COSTS["D"] if codes[i] not in "eE" else BROKEN_OFF * (codes[i] == "E"))
        return [max(0, n - COSTS["D"] * (goals == (SYSTEM,) and start == START)) for n in out]
    behind = "$" if last else None  # the row behind, if no pair has used it
    for i in range(len(codes) - 1, -1, -1):
        code = codes[i]
        role = code.lower()
        if code == DELETED:
            out[i] = out[i + 1] + COSTS["D"]
            continue
        out[i] = out[i + 1] + (BROKEN_OFF if code.isupper() else 0)
        if role == "x":
            out[i] += COSTS["R"]
            behind = None
        elif role == "e":
            behind = None
        elif behind and role + behind not in LEGAL:
            out[i] += COSTS["R"]
            behind = None
        else:
            behind = role
    return out


def edit(codes: str, i: int, state: int, letter: str, last: bool) -> tuple[int, int, int] | None:
    """(cost, rows consumed, state) after one edit, None where it can't be made."""
    if letter == "I":
        return (COSTS["I"], i, DUE[state]) if i < len(codes) or last else None
    if i == len(codes):
        return None
    if letter == "D":
        return COSTS["D"], i + 1, state
    code = codes[i]
    if code == DELETED:
        return None
    more = BROKEN_OFF if code.isupper() else 0
    if letter == "R":
        return COSTS["R"] + more, i + 1, DUE[state]
    after = FITS[code.lower()].get(state)
    return None if after is None else (COSTS["K"] + more, i + 1, after)


def search(codes: str, start: int, goals: tuple[int, ...], last: bool) -> tuple[int, str] | None:
    """(cost, edits) of the first cheapest path from a state over all rows to a goal state; None if there is none."""
    n, rest = len(codes), at_least(codes, last, goals, start)
    need: dict[tuple[int, int], int] = {}  # failed states, and the least budget that may succeed there
    most = COSTS["D"] * n + 2 * COSTS["I"]  # deleting all rows and inserting what is due reaches what can be reached at all
    bound = rest[0]
    while bound <= most + sum(c.isupper() for c in codes):
        path = _within(codes, start, goals, last, bound, rest, need)
        if path is not None:
            return bound, path
        bound = need[0, start]
    return None


def _within(codes, start, goals, last, bound, rest, need) -> str | None:
    """Depth-first search within a cost bound."""
    n = len(codes)
    if n == 0 and start in goals:
        return ""
    path: list[str] = []
    stack = [[0, start, bound, 0, IMPOSSIBLE, 0]]  # rows consumed, state, budget, next edit, least need seen, cost of the edit
    while stack:
        frame = stack[-1]
        i, state, budget, turn = frame[:4]
        if turn == len(EDITS):
            need[i, state] = frame[4]
            stack.pop()
            if stack:
                path.pop()
                stack[-1][4] = min(stack[-1][4], frame[5] + frame[4])
            continue
        frame[3] += 1
        step = edit(codes, i, state, EDITS[turn], last)
        if step is None:
            continue
        cost, then, after = step
        least = cost + need.get((then, after), rest[then])
        if least > budget:
            frame[4] = min(frame[4], least)
            continue
        path.append(EDITS[turn])
        if then == n and after in goals:
            return "".join(path)
        stack.append([then, after, budget - cost, 0, IMPOSSIBLE, cost])
    return None


def search_segment(codes: str, first: bool, last: bool) -> tuple[list[int], list[str]]:
    """Costs and edits from every state before (rows of four) to every state after; a last segment has its end as the first of them."""
    costs, paths = [IMPOSSIBLE] * 16, [""] * 16
    keeps_system = any(c in "sS" for c in codes) or "e" in codes.lower()
    for before in (START,) if first else range(4):
        for after in (START,) if last else range(4):
            goals = (START, ASSISTANT) if last else (after,)
            # nothing leads back to the start, and only a system row leads to the state after it
            if not last and ((after == START and before != START) or (after == SYSTEM and before not in (START, SYSTEM))):
                continue
            if not last and after == SYSTEM and before == START and not keeps_system:
                continue
            found = search(codes, before, goals, last)
            if found:
                costs[4 * before + after], paths[4 * before + after] = found
    return costs, paths


def choose(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int]]:
    """Cost of the cheapest way through the segments, and which of the 16 paths the first such way takes in each."""
    ahead = [[0] * 4]
    for c in reversed(costs):
        ahead.append([min(c[4 * s + t] + ahead[-1][t] for t in range(4)) for s in range(4)])
    ahead.reverse()
    state, taken = START, []
    for k, c in enumerate(costs):
        best = [t for t in range(4) if c[4 * state + t] + ahead[k + 1][t] == ahead[k][state]]
        after = min(best, key=lambda t: ranks[k][4 * state + t])
        taken.append(4 * state + after)
        state = after
    return ahead[0][START], taken


def judged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, fault of the row by itself)."""
    blank = F.lit(" ")
    rows = rows.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    ending = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    fault = F.when(ending == "", "blank").when(~ending.isin(".", "!", "?"), "truncated")
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.select("*", digest.alias("digest"), fault.alias("fault"))


def numbered(rows: DataFrame) -> DataFrame:
    """A narrow row per row: its place, first fault, code, and whether it follows its neighbour as it may."""
    initial = F.substring("role", 1, 1)
    thin = judged(rows).select("conv_id", "turn", "role", "digest", "fault", initial.alias("initial"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    alike = Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first(), "role")
    seen = thin.withColumn("copy", F.row_number().over(alike)).select(
        "conv_id", "turn", "initial", (F.row_number().over(in_order) - 1).alias("place"),
        F.when((F.col("copy") > 1) & ~F.coalesce(F.col("fault") == "blank", F.lit(False)), "duplicate").otherwise(F.col("fault")).alias("fault"),
        F.lag("initial").over(in_order).alias("before"), F.lag("turn").over(in_order).alias("last_turn"),
        F.lead(F.lit(True)).over(in_order).isNull().alias("is_last"),
    )
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).when(F.col("initial") == "", "e").otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), DELETED).when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    return seen.select(
        "conv_id", "turn", "place", "fault", "is_last", code.alias("code"),
        (F.col("before").isNotNull() & ~F.coalesce(legal, F.lit(False))).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.col("last_turn"), F.lit(False))).alias("new_turn"),
    )


def searched(places: DataFrame, segment: int) -> DataFrame:
    """(conv_id, segment, costs, ranks, paths) of every segment, and its counts."""
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda r: r["code"]), "")
    cut = places.groupBy("conv_id", F.floor(F.col("place") / segment).cast("long").alias("segment")).agg(
        codes.alias("codes"), F.max("is_last").alias("is_last"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.count_if("new_turn").alias("turns"), F.count_if("illegal").alias("illegal"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )

    @F.pandas_udf("struct<costs:array<long>,ranks:array<int>,paths:array<string>>")
    def run(codes: pd.Series, number: pd.Series, is_last: pd.Series) -> pd.DataFrame:
        out = []
        for c, k, end in zip(codes, number, is_last):
            costs, paths = search_segment(c, k == 0, end)
            ranks = [0] * 16
            for s in range(4):
                for rank, t in enumerate(sorted(range(4), key=lambda t: paths[4 * s + t])):
                    ranks[4 * s + t] = rank
            out.append((costs, ranks, paths))
        return pd.DataFrame(out, columns=["costs", "ranks", "paths"])

    # the segments of one long conversation are searched in many tasks
    tasks = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes can be much work
    dealt = cut.repartition(tasks, "conv_id", "segment")
    return dealt.withColumn("found", run("codes", "segment", "is_last")).drop("codes", "is_last").select("*", "found.*").drop("found")


def plan(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """A report row per conversation (gaps, faults, illegal, cost), and (conv_id, segment, audit): the edits' initials in pieces."""
    found = materialize(searched(numbered(rows), segment), "segments")

    @F.pandas_udf("struct<cost:long,taken:array<int>>")
    def way(costs: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([choose(list(c), list(r)) for c, r in zip(costs, ranks)], columns=["cost", "taken"])

    in_order = F.array_sort(F.collect_list(F.struct("segment", "costs", "ranks")))  # 16 costs for every 256 rows
    per_conversation = found.groupBy("conv_id").agg(
        in_order.alias("all"), F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
    )
    chosen = materialize(per_conversation.withColumn(
        "way", way(F.transform("all", lambda s: s["costs"]), F.transform("all", lambda s: s["ranks"]))
    ).drop("all"), "ways")
    report = chosen.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("way.cost").alias("cost"))
    ways = chosen.select(F.struct("conv_id").alias("at"), F.posexplode("way.taken").alias("segment", "taken"))
    audits = found.withColumn("at", F.struct("conv_id")).join(ways, ["at", "segment"]).select(
        "conv_id", "segment", F.element_at("paths", F.col("taken") + 1).alias("audit"))
    return report, audits


def _in_order(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Every conversation's audit pieces and then its rows, together and in order."""
    null = F.lit(None)
    marks = audits.select("conv_id", F.col("segment").alias("mark"), null.cast("long").alias("turn"), null.cast("string").alias("role"),
                          null.cast("binary").alias("digest"), F.col("audit").alias("text"))
    wide = judged(rows).select("conv_id", null.cast("long").alias("mark"), F.col("turn").cast("long").alias("turn"), "role", "digest", "text")
    return marks.unionByName(wide).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("mark").asc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "digest"
    ).select("conv_id", "mark", "role", "text")


def follow(batches) -> Iterator[tuple]:
    """(conv_id, edit, role, text) of every edit in order; text and role are the repaired ones."""
    current, audit, at, state, open_ = None, [], 0, START, False

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = DUE[state], at + 1
            yield current, "I", ROLES[state], ""

    for batch in batches:
        for conv_id, mark, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "mark", "role", "text"))):
            if mark is not None:
                if mark == 0:
                    yield from inserts()  # those at the end of the conversation before
                    current, audit, at, state = conv_id, "", 0, START
                audit += text
                continue
            yield from inserts()
            letter, at = audit[at], at + 1
            if letter == "R":
                state = DUE[state]
                role = ROLES[state]
            elif letter == "K" and role:
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield current, letter, role, text
    yield from inserts()


def _streamed(rows: DataFrame, audits: DataFrame, made, columns: dict[str, str]) -> DataFrame:
    """conv_id and the given columns of the tuples that ``made`` makes of the edits in order."""
    kind = rows.schema["conv_id"].dataType
    kinds = [to_arrow_type(kind), *(pa.int64() if t == "long" else pa.string() for t in columns.values())]
    schema = ", ".join(["conv_id " + kind.simpleString(), *(f"{n} {t}" for n, t in columns.items())])

    def run(batches):
        for out in _chunks(made(follow(batches))):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", *columns])

    return _in_order(rows, audits).mapInArrow(run, schema)


def _chunks(items, size: int = 1000) -> Iterator[list]:
    items = iter(items)
    while chunk := list(itertools.islice(items, size)):
        yield chunk


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the rows of every repaired conversation, deleted ones without a place."""

    def made(edits):
        current, place = object(), 0
        for conv_id, letter, role, text in edits:
            if conv_id != current:
                current, place = conv_id, 0
            yield conv_id, None if letter == "D" else place, role, text, letter
            place += letter != "D"

    return _streamed(rows, audits, made, {"place": "long", "role": "string", "text": "string", "edit": "string"})


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): sha256 of the repaired ``role:text`` lines of every conversation with rows."""

    def made(edits):
        for conv_id, found in itertools.groupby(edits, key=lambda e: e[0]):
            letters, hasher, lead = [], hashlib.sha256(), ""
            for _, letter, role, text in found:
                letters.append(letter)
                if letter != "D":
                    hasher.update(f"{lead}{role}:{text}".encode())
                    lead = "\n"
            yield conv_id, "".join(letters), hasher.hexdigest()

    return _streamed(rows, audits, made, {"audit": "string", "repaired_sha256": "string"})


def summarize(ids: DataFrame, rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for every given conv_id: report, audit and hash of its repaired rows; zeros where it has no rows."""
    report, audits = plan(rows, segment)
    at = F.struct("conv_id").alias("at")  # nulls in a struct are equal, so a null id meets itself
    every = ids.select("conv_id").distinct().select(at)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = every.join(report.select(at, *counts), "at", "left").join(
        digests(rows, audits).select(at, "audit", "repaired_sha256"), "at", "left")
    return found.select(
        "at.conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of their id and turn: a test of the repair on any table of conversations."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    hit = rows.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).where("kind <> 0")
    return hit.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
