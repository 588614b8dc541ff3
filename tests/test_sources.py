import hashlib

import pytest
from pyspark.sql import functions as F

from helpers import grade_frame, records
from termgrid.functions import text as txt
from termgrid.operators import eventlog, explore
from termgrid.sources.scratch import spread
from termgrid.sources import manifest as M, tables as T


def test_grade_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "grades")
    T.write_csv(grade_frame(spark, [{"Course Title": 'Say "hi", twice'}, {"W": "x"}]), path)
    rows = T.read_grade_rows(spark, path)
    assert {r["title"] for r in records(rows)} == {'Say "hi", twice', "Intro"}
    with pytest.raises(ValueError):
        T.read_csv_text(spark, path, ["Nope"])


def test_typed_meetings_and_sections(spark, tmp_path):
    row = {c: "" for c in T.MEETING_FIELDS} | {"weekdays": "MON|WED", "meeting_index": "2", "is_tba": "Yes", "end_time": "10:00"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    T.write_csv(df, str(tmp_path / "m"), T.MEETING_FIELDS)
    got = records(T.read_meetings(spark, str(tmp_path / "m")))[0]
    assert (got["weekdays"], got["meeting_index"], got["is_tba"], got["is_arranged"]) == (["MON", "WED"], 2, True, False)
    assert got["start_time"] is None and got["end_time"] == "10:00" and got["room"] == ""
    sec = {c: "s" for c in T.SECTION_FIELDS} | {"credit_min": "3", "credit_max": "x"}
    T.write_csv(spark.createDataFrame([tuple(sec.values())], ", ".join(f"{c} string" for c in sec)), str(tmp_path / "s"))
    got = records(T.read_sections(spark, str(tmp_path / "s")))[0]
    assert got["credit_min"] == 3.0 and got["credit_max"] is None
    T.write_report(spark.range(1).select(F.lit(2).alias("b"), F.lit(1).alias("a")), str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()] == ['{"a":1,"b":2}']


def test_manifest_and_coverage(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes(b"Year,Term\n")
    got = records(M.file_manifest(M.read_files(spark, str(tmp_path / "g.csv"))))[0]
    assert got["sha256"] == hashlib.sha256(b"Year,Term\n").hexdigest() and got["bytes"] == 10
    cover = records(M.source_coverage(grade_frame(spark, [{"Term": "Fall"}, {"Year": 2022}, {}])))[0]
    assert cover == {"record_count": 3, "years": "2021,2022", "terms": "fall,spring"}


def test_files_of_any_size_are_hashed_in_pieces(spark, tmp_path):
    (tmp_path / "a b.xml").write_bytes(b"<a/>" * 1000)
    (tmp_path / "empty.xml").write_bytes(b"")
    with open(tmp_path / "large.bin", "wb") as sparse:
        sparse.truncate((2 << 30) + 5)  # beyond what a row can hold
    got = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["bytes"]) for r in records(M.hashed_files(spark, str(tmp_path)))}
    assert "empty.xml" not in got  # Spark's scans list no empty files
    assert [got[n] for n in got if n.startswith("a")] == [(hashlib.sha256(b"<a/>" * 1000).hexdigest(), 4000)]
    whole, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2 << 10):
        whole.update(block)
    whole.update(bytes(5))
    assert got["large.bin"] == (whole.hexdigest(), (2 << 30) + 5)
    one_byte = records(M.hashed_files(spark, str(tmp_path / "a b.xml"), piece=1))[0]
    assert one_byte["sha256"] == hashlib.sha256(b"<a/>" * 1000).hexdigest()


def test_fetch_errors_and_no_live_access(spark):
    df = spark.createDataFrame(
        [("a", 200, False, "x", None), ("b", 429, False, "", None), ("c", None, False, "", "timed out"), ("d", None, True, "y", None),
         ("e", 500, None, "", None), ("f", None, None, None, None)],
        "url string, status int, from_cache boolean, body string, failure string")
    live = {r["url"]: (r["status"], r["http_status"], r["bytes"], r["error"]) for r in records(M.fetch_records(df))}
    refused = "; WAF/rate-limit/block evidence preserved; no bypass attempted"
    assert live == {
        "a": ("ok", "200", 1, ""), "b": ("blocked", "429", 0, "HTTP 429" + refused), "c": ("network_error", "", 0, "timed out"),
        "d": ("cache", "cache", 1, ""), "e": ("http_error", "500", 0, "HTTP 500" + refused), "f": ("network_error", "", 0, "")}
    stored = {r["url"]: (r["status"], r["http_status"], r["error"]) for r in records(M.fetch_records(df, allow_live=False))}
    assert stored.pop("d") == ("cache", "cache", "")
    assert set(stored.values()) == {("blocked", "", M.OFFLINE)}


def test_responses(spark):
    rows = [("a", 200, "", "text/xml", "<a/>", False), ("b", 202, "", "", "", False), ("c", 200, "challenge", "", "<a/>", False),
            ("d", 429, "", "", "", False), ("e", 200, "", "", "  <HTML>", False), ("f", 200, "", "", "<a><b></a>", True),
            ("g", None, "", "", "", False), ("h", 200, "", "", "", False)]
    df = spark.createDataFrame(rows, "url string, status int, header_action string, content_type string, body string, from_cache boolean")
    errors = {r["url"]: r["error"] for r in records(M.probe_errors(df.where("status is not null")))}
    assert errors["a"] == "" and errors["d"] == "HTTP 429" and errors["h"] == "empty body"
    assert "challenge" in errors["b"] and "challenge" in errors["c"] and "HTML" in errors["e"] and errors["f"] == "invalid XML"
    status = {r["url"]: r["status"] for r in records(M.fetch_records(df))}
    assert (status["a"], status["b"], status["d"], status["f"], status["g"]) == ("ok", "http_error", "blocked", "cache", "network_error")
    asked = df.select(F.lit("s").alias("source"), "url")
    table = M.combined_manifest(asked, asked.limit(3), asked.limit(5))
    assert records(table)[0] == {"source": "s", "requested": 8, "files": 3, "failures": 5, "complete": False}
    with pytest.raises(RuntimeError):
        M.require_complete(table)
    M.require_complete(table, allow_partial=True)


def test_event_logs(spark):
    def chain(log, actions, tamper=None, skip=None):
        rows, previous = [], "0" * 64
        for i, action in enumerate(actions, start=1):
            payload = f"p{i}"
            digest = hashlib.sha256(f"{i}|{action}|{payload}|{previous}".encode()).hexdigest()
            if i != skip:
                rows.append((log, i, action, "changed" if i == tamper else payload, previous, digest))
            previous = digest
        return rows

    rows = chain("good", ["add", "done"]) + chain("bad", ["add", "done", "add"], tamper=2) + chain("gap", ["add", "add", "add"], skip=2)
    df = spark.createDataFrame(rows, "log_id string, sequence int, action string, payload string, prev_hash string, event_hash string")
    out = {r["log_id"]: r for r in records(eventlog.verify_logs(df, ("sequence", "action", "payload", "prev_hash"), {"done": "accepted"}))}
    assert out["good"]["ok"] and out["good"]["status"] == "accepted"
    assert out["bad"]["bad_hashes"] == 1 and not out["bad"]["ok"]
    assert not out["gap"]["contiguous"] and out["gap"]["bad_links"] == 1 and out["gap"]["status"] == "planned"
    stored = spark.createDataFrame([("good", "accepted", 1), ("bad", "planned", 2), ("gap", "planned", 3)], "log_id string, status string, attempts long")
    found = {r["log_id"]: r for r in records(eventlog.verify_logs(
        df, ("sequence", "action", "payload", "prev_hash"), {"done": "accepted"}, allowed={"add": ("planned",)}, stored=stored, counted="add"))}
    assert found["good"]["ok"] and found["good"]["head_hash"] == rows[1][5]
    assert not found["bad"]["agrees"] and found["bad"]["illegal"] == 1 and found["bad"]["stored_status"] == "planned"
    assert not found["gap"]["agrees"] and found["gap"]["attempts"] == 2 and found["gap"]["illegal"] == 0
    twice = df.where("log_id = 'good'").unionByName(df.where("log_id = 'good'"))
    assert not records(eventlog.verify_logs(twice, ("sequence", "action", "payload", "prev_hash"), {}))[0]["ok"]


def test_states_of_a_long_log(spark, monkeypatch):
    monkeypatch.setattr(eventlog, "PIECE", 64)
    actions = [("go", "stop", "note", "go")[i * i % 4] if i % 5 else "odd" for i in range(5000)]
    df = spark.createDataFrame([("a", i + 1, a) for i, a in enumerate(actions)] + [("b", 1, "note")], "log_id string, sequence int, action string")
    moves, allowed = {"go": "running", "stop": "idle"}, {"go": ("idle",), "stop": ("running",), "odd": ("running",)}
    state, illegal = "idle", 0
    for a in actions:
        illegal += a in allowed and state not in allowed[a]
        state = moves.get(a, state)
    got = {r["log_id"]: (r["status"], r["illegal"]) for r in eventlog.derived_states(df, moves, allowed, "idle").collect()}
    assert got == {"a": (state, illegal), "b": ("idle", 0)} and illegal > 100


def test_exploration(spark):
    df = spark.createDataFrame(
        [(2021, "spring", "CS", "101", "B", 10.0, 1.0, 0.1), (2021, "fall", "CS", "101", " ", 20.0, 2.0, 0.1), (2022, "fall", "MATH", "1", "M", 5.0, 0.0, 0.0)],
        "year int, term string, subject string, number string, title string, demand_proxy double, w double, w_mark_share double")
    cs = [r for r in records(explore.course_demand(df)) if r["subject"] == "CS"][0]
    assert (cs["demand_proxy_total"], cs["course_term_count"], cs["title"], cs["w_proxy_weighted"]) == (30, 2, "B", 0.1)
    assert explore.filter_rows(df, [2021], ["fall"]).count() == 1 and explore.filter_rows(df, [2021, 2022], ["fall"], ["CS"]).count() == 1
    assert [r["demand_proxy"] for r in explore.top_n(df, 2, "demand_proxy", ["year"]).collect()] == [20, 10]
    assert explore.top_stable_share(df, 5).count() == 1
    assert records(explore.sample_rows(df, 2), "number") == records(explore.sample_rows(df.orderBy("number"), 2), "number")
    label = df.select(explore.labelled(F.col("term"), {"fall": "Fall"}).alias("x")).distinct()
    assert {r["x"] for r in records(label)} == {"Fall", "spring"}
    renamed = explore.canonical_predictions(df.select(F.col("year").alias("target_year"), F.col("w").alias("y_true"), "subject"))
    assert renamed.columns == ["year", "subject", "actual_w", "term", "number", "title", "course"]
    keys = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "1")], "subject string, number string")
    split = records(explore.special_key_split(keys, keys.limit(2)))[0]
    assert split == {"keys": 3, "overlap": 2, "only": 1}


def test_titles(spark):
    df = spark.createDataFrame([("  Intro!  to C++ ",), ("Élan_2 & Ärger",), (None,), ("Selected topics: X",), ("ADVANCED SPECIAL TOPIC",), ("Special Research Problems",), ("Specialtopics",)], "t string")
    got = df.select(txt.title_norm(F.col("t")).alias("n"), txt.is_special_topic(F.col("t")).alias("s")).collect()
    assert [r["n"] for r in got][:3] == ["intro to c", "élan_2 ärger", ""]
    assert [r["s"] for r in got] == [False, False, False, True, True, True, False]


def test_partitions_follow_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(0, 1000, 1, 1)
    assert spread(few).rdd.getNumPartitions() == cores
    many = spread(few, 20)
    assert many.rdd.getNumPartitions() == 50 and many.count() == 1000
    assert spread(few, 10_000).rdd.getNumPartitions() == cores and spread(many, 100).rdd.getNumPartitions() == 50
