"""The repair against dynamic programming over all edits, and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib

import pytest

from termgrid.llm import conversations as cv
from termgrid.llm import queries


def cheapest(codes):
    """(cost, edits) by dynamic programming: the least (cost, edits) to every (row, state)."""
    best = {cv.START: (0, "")}

    def with_inserts(states):
        for _ in range(4):
            for s, (c, p) in list(states.items()):
                new = (c + 2, p + "I")
                if new < states.get(cv.DUE[s], (1 << 40, "")):
                    states[cv.DUE[s]] = new
        return states

    for code in codes:
        after = {}
        for s, (c, p) in with_inserts(best).items():
            for letter in "DKR":
                step = cv.edit(code, 0, s, letter, False)
                if step:
                    new = (c + step[0], p + letter)
                    if new < after.get(step[2], (1 << 40, "")):
                        after[step[2]] = new
        best = after
    ends = with_inserts(best)
    return min(ends[s] for s in (cv.START, cv.ASSISTANT) if s in ends)


def through_segments(codes, size):
    cut = [codes[i : i + size] for i in range(0, len(codes), size)]
    found = [cv.search_segment(c, k == 0, k == len(cut) - 1) for k, c in enumerate(cut)]
    ranks = []
    for _, paths in found:
        ranks.append([sorted(range(4), key=lambda t: paths[4 * s + t]).index(t) for s in range(4) for t in range(4)])
    cost, taken = cv.choose([c for c, _ in found], ranks)
    return cost, "".join(paths[t] for (_, paths), t in zip(found, taken))


def test_search_is_the_cheapest_and_first():
    rng = random.Random(4)
    for n in [*range(1, 7)] * 120 + [20, 40, 60] * 10:
        codes = "".join(rng.choice("sSuUuaAaxXeED") for _ in range(n))
        want = cheapest(codes)
        assert cv.search(codes, cv.START, (cv.START, cv.ASSISTANT), True) == want, codes
        assert through_segments(codes, 3) == want == through_segments(codes, 7), codes
        assert cv.at_least(codes, True)[0] <= want[0]


def test_long_conversations_take_linear_time():
    rng = random.Random(5)
    codes = "".join(rng.choice("uauauauauauuaDUA") for _ in range(3000))
    assert through_segments(codes, cv.SEGMENT) == cheapest(codes)


def plain(rows):
    """The query's contract, row by row."""
    blank = re.compile(r"[^\x20\x09-\x0D]")
    by_id = {}
    for conv_id, turn, role, text in rows:
        mine = by_id.setdefault(conv_id, [])
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv_id, mine in by_id.items():
        digest = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        mine = sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        faults, seen = [], set()
        for _, role, text in mine:
            last = blank.findall(text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        codes = ""
        for (_, role, _), fault in zip(mine, faults):
            code = role[0] if role[:1] in ("s", "u", "a") else "x" if role else "e"
            codes += "D" if fault in ("blank", "duplicate") else code.upper() if fault else code
        cost, audit = cheapest(codes)
        lines, k, state = [], 0, cv.START
        for letter in audit:
            if letter == "I":
                state = cv.DUE[state]
                lines.append(cv.ROLES[state] + ":")
                continue
            _, role, text = mine[k]
            k += 1
            if letter == "R":
                state = cv.DUE[state]
                role = cv.ROLES[state]
            elif letter == "K" and role:
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            if letter != "D":
                lines.append(f"{role}:{text}")
        initials = "".join(line[:1] for line in lines if not line.startswith(":"))
        assert re.fullmatch("(s?(ua)+)?", initials)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for c in range(150):
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "agent"])
            out.append((c, rng.choice([t, t, t, t * 3, None]), role, rng.choice([f"Text {c} {t}.", "Same.", "cut", "  ", "", None, "Why?\n", "x! \t", "é…"])))
    out += [(None, t, r, "Hi!") for t, r in enumerate(["user", "assistant", "user"])]
    out += [(1000, None, "user", "a.")] * 3 + [(1001, 5, "user", "b" * 1_000_000 + ".")] + [(1002, t, "user" if t % 2 == 0 else "assistant", f"{t} ok.") for t in range(700)]
    dropped = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return out + [(dropped, 0, "user", "gone.")]


def test_query(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS mark", "1 AS segment")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.queries()["op12_conversations"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {f.dataType.simpleString() for f in got.schema[:7]} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_query_on_a_given_table(spark):
    path = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.queries()["op12_conversations"](spark, path).collect()), key=str) == plain(given)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Q?"), (1, 1, "user", "A."), (1, 1, "user", "A."), (2, 0, "assistant", "Lone."), (3, 7, "system", "S."), (3, 8, "user", "U!"), (3, 9, "assistant", "yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, audits = cv.plan(df)
    out = {}
    for r in cv.repaired(df, audits).collect():
        out.setdefault(r.conv_id, []).append((r.place, r.role, r.text, r.edit))
    assert out[1] == [(0, "user", "Q?", "K"), (1, "assistant", "A.", "R"), (None, "user", "A.", "D")]
    assert out[2] == [(0, "user", "", "I"), (1, "assistant", "Lone.", "K")]
    assert out[3] == [(0, "system", "S.", "K"), (1, "user", "U!", "K"), (2, "assistant", "yes", "K")]
    assert {r.conv_id: r.cost for r in report.collect()} == {1: 5, 2: 2, 3: 1}


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.summarize(df.select("conv_id"), df).count() == 0
