import random

import pytest
from pyspark.sql import functions as F

from helpers import records
from termgrid.functions import text as txt
from termgrid.operators import conflicts as C, schedule as S
from termgrid.sources import documents as X


def meeting(days, start, end, room="1", dates=""):
    return (f"<meeting><type>Lecture</type><days>{days}</days><start>{start}</start><end>{end}</end>"
            f"<room>{room}</room>{dates}</meeting>")


def section(crn, body, start="2023-08-21", end="2023-12-06"):
    return (f'<section id="{crn}"><sectionNumber>L{crn}</sectionNumber><partOfTerm>1</partOfTerm>'
            f"<startDate>{start}</startDate><endDate>{end}</endDate>{body}</section>")


SUMMER = "<startDate>6/1/2023</startDate><endDate>6/30/2023</endDate>"
COURSE = '<course id="CS 101" href="/cs/101"><title>Logic &amp; Sets</title><creditHours>3 hours</creditHours>' \
    "<genEdAttributes><genEdAttribute>QR</genEdAttribute></genEdAttributes><prerequisites>MATH 220</prerequisites>" \
    "<sections>" + "".join([
        section(1, "<meetings>" + meeting("MWF", "10:00 AM", "10:50 AM") + "</meetings><instructors><instructor><name>Ada</name>"
                "<email>a@x</email></instructor><instructor><name>Bo</name></instructor><instructor><name>Ada</name></instructor></instructors>"),
        section(2, meeting("MWF", "10:30 AM", "11:20 AM")),
        section(3, meeting("ARRANGED", "ARRANGED", "ARRANGED")),
        section(4, meeting("MWF", "10:00", "11:00", "TBA")),
        section(5, meeting("MWF", "10:00 AM", "10:50 AM", dates=SUMMER)),
    ]) + "</sections></course>"


@pytest.fixture(scope="module")
def parsed(spark):
    docs = [("2023-fall", "a", COURSE), ("2023-fall", "b", "<course id='X 1'><name>x</course>"), ("2023-fall", "c", None)]
    docs = spark.createDataFrame(docs, "term string, doc_order string, xml string")
    return docs, {name: df.cache() for name, df in X.document_tables(docs).items()}


def test_document_tables(parsed):
    docs, tables = parsed
    assert {n: df.count() for n, df in tables.items()} == {
        "courses": 1, "sections": 5, "meetings": 5, "instructors": 2, "gened": 5, "prerequisites": 1}
    course = records(tables["courses"])[0]
    assert (course["course_id"], course["title"], course["credit_min"]) == ("2023-fall:CS 101", "Logic & Sets", 3.0)
    meetings = {r["crn"]: r for r in records(tables["meetings"])}
    assert meetings["1"]["weekdays"] == ["MON", "WED", "FRI"] and meetings["2"]["start_time"] == "10:30"
    assert meetings["3"]["is_arranged"] and meetings["3"]["weekdays"] == [] and meetings["4"]["is_tba"]
    assert meetings["5"]["start_date"] == "2023-06-01" and meetings["1"]["end_date"] == "2023-12-06"
    people = [(r["instructor_index"], r["name"], r["email"]) for r in records(tables["instructors"], "instructor_index")]
    assert people == [(0, "Ada", "a@x"), (1, "Bo", "")]
    assert {r["doc_order"] for r in records(X.unreadable_documents(docs))} == {"b", "c"}


def test_later_document_wins(spark, parsed):
    docs, _ = parsed
    newer = docs.where("doc_order = 'a'").select(
        "term", F.lit("z").alias("doc_order"), F.replace("xml", F.lit("Logic"), F.lit("Proofs")).alias("xml"))
    courses = records(X.course_table(X.parse_documents(docs.unionByName(newer))))
    assert [r["title"] for r in courses] == ["Proofs & Sets"]


def test_namespaced_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<n:course xmlns:n="urn:x" id="CS 9"><n:title>T</n:title></n:course>')
    docs = X.read_documents(spark, str(tmp_path), "2023-fall")
    assert [r["number"] for r in records(X.course_table(X.parse_documents(docs)))] == ["9"]
    (tmp_path / "s.xml").write_text('<subject id="CS"><courses><course id="CS 1" href="/1"/><course id="CS 2"/></courses></subject>')
    refs = X.subject_references(spark, str(tmp_path / "s.xml"))
    assert [(r["id"], r["href"]) for r in records(refs)] == [("CS 1", "/1")]


ODD = (
    '<r:list xmlns:r="urn:r"><note>kept apart</note><r:course id="CS 102"><info><title>Deep</title></info><creditHours/>'
    "<genEdAttribute>QR</genEdAttribute><genEdAttribute>QR</genEdAttribute><prerequisite> </prerequisite><more><prerequisites>CS 101</prerequisites></more>"
    '<block><section><callNumber>77</callNumber><section>A</section><creditHours>2 hours</creditHours><color>red</color>'
    "<slot><meeting><type> </type><meetingType>Lab</meetingType><days>ARR</days><instructors><instructor>Cy</instructor><instructor><name/>Di"
    "</instructor><instructor>Cy</instructor></instructors><x><genEdAttribute>HUM</genEdAttribute></x></meeting></slot></section></block>"
    "</r:course><course id='CS 999'/></r:list>"
)


def test_documents_of_any_layout(spark):
    docs = spark.createDataFrame([("t", 1, ODD), ("t", 2, "<course><name>CS 103</name><![CDATA[ ]]></course>"), ("t", 3, "<x><y/></x>"),
                                  ("t", 4, "<course>&nope;</course>"), ("t", 5, "")], "term string, doc_order int, xml string")
    courses, sections = X.parsed_tables(docs)
    tables = {name: records(df) for name, df in X.tables_of(courses, sections).items()}
    course = next(r for r in tables["courses"] if r["number"] == "102")
    assert (course["title"], course["credit_text"], course["course_id"]) == ("Deep", "", "t:CS 102")
    assert {(r["subject"], r["number"]) for r in tables["courses"]} == {("CS", "102"), ("CS", "103"), ("", "")}
    # a section's number may stand in a child of the same name, which is a section by its name too
    assert {(r["crn"], r["section_number"], r["credit_min"]) for r in tables["sections"]} == {("77", "A", 2.0), ("UNKNOWN-1", "", None)}
    lab = tables["meetings"][0]
    assert len(tables["meetings"]) == 1 and lab["meeting_type"] == "" and lab["is_arranged"]
    # the second one's text stands behind a child, where an element's own text has ended
    assert [(r["instructor_index"], r["name"]) for r in tables["instructors"]] == [(0, "Cy")]
    assert {(r["crn"], r["attribute_code"]) for r in tables["gened"]} == {("77", "HUM"), ("UNKNOWN-1", "QR")}
    assert [r["prerequisite_text"] for r in tables["prerequisites"]] == ["CS 101"]
    assert {r["doc_order"] for r in records(X.unreadable_documents(docs))} == {4, 5}
    lost = {(r["parent_tag"], r["tag"], r["elements"]) for r in records(X.unmatched_elements(docs))}
    assert lost == {("list", "note", 1), ("section", "color", 1)}


def test_deep_and_wide_documents(spark):
    wide = "<course id='CS 1'>" + "".join(f"<section id='{i}'><meeting><days>M</days></meeting></section>" for i in range(3000)) + "</course>"
    deep = "<course id='CS 2'>" + "<a>" * 3000 + "<section id='d'/>" + "</a>" * 3000 + "</course>"
    docs = spark.createDataFrame([("t", 1, wide), ("t", 2, deep)], "term string, doc_order int, xml string")
    assert {n: df.count() for n, df in X.document_tables(docs).items()} == {
        "courses": 2, "sections": 3001, "meetings": 3000, "instructors": 0, "gened": 0, "prerequisites": 0}


def test_evidence_counts_every_copy(spark, parsed):
    docs, _ = parsed
    again = docs.where("doc_order = 'a'").withColumn("doc_order", F.lit("d"))
    alone = spark.createDataFrame([("2023-fall", "e", "<course id='EE 1'/>")], "term string, doc_order string, xml string")
    courses, sections = X.parsed_tables(docs.unionByName(again).unionByName(alone))
    tables = {k: v for k, v in X.tables_of(courses, sections).items() if k != "courses"}
    fetched = spark.createDataFrame([("2023-fall", "CS", "ok", "200", "h")], "term string, subject string, status string, http_status string, sha256 string")
    rows = {r["subject"]: r for r in records(S.quality_rows(fetched, tables, (courses, sections)))}
    assert (rows["CS"]["source_rows"], rows["CS"]["normalized_rows"], rows["CS"]["kept_rows"], rows["CS"]["verified"]) == (36, 36, 18, True)
    assert (rows["EE"]["source_rows"], rows["EE"]["acquisition_status"], rows["EE"]["verified"]) == (0, "missing", False)


def test_missing_entries_are_rows(spark):
    s = spark.createDataFrame([("x", "t", "CS", "1", "9", "S", "1", "2023-01-01", "2023-05-01", 3.0, 3.0)],
                              "section_id string, term string, subject string, number string, crn string, section_number string, "
                              "part_of_term string, start_date string, end_date string, credit_min double, credit_max double")
    m = spark.range(1_000_000).select(
        F.lit("x").alias("section_id"), F.col("id").cast("int").alias("meeting_index"), F.array(F.lit("MON")).alias("weekdays"), F.lit("09:00").alias("start_time"),
        F.lit("").alias("end_time"), F.lit("1").alias("room"), F.lit(False).alias("is_arranged"), F.lit(False).alias("is_tba"))
    entries = S.missing_entries(s, m)
    assert entries.count() == 1_000_000 and entries.where("meeting_index = 5").first()["field"] == "meeting.5.end_time"


def test_conflicts_of_the_fixture(parsed):
    _, tables = parsed
    edges = records(C.conflict_edges(tables["sections"], tables["meetings"]))
    assert {(e["crn_a"], e["crn_b"], e["day"], e["overlap_minutes"]) for e in edges} == {
        ("1", "2", day, 20) for day in ("MON", "WED", "FRI")}
    moved = tables["sections"].withColumn("term", F.when(F.col("crn") == "2", "2022-fall").otherwise(F.col("term")))
    assert C.conflict_edges(moved, tables["meetings"]).isEmpty()


def random_timetable(spark, n=150):
    rng = random.Random(11)
    sections, meetings = [], []
    for i in range(n):
        sid = f"t{i % 2}:CS {i}:{i}"
        sections.append((sid, f"t{i % 2}", str(i), "CS", str(i), "L", "2023-01-01", "2023-05-30" if i % 9 else ""))
        for m in range(rng.randint(1, 4)):
            start = 600 if rng.random() < 0.4 else rng.randint(480, 1000)
            end = start + rng.choice([-10, 0, 20, 50, 75])
            low = rng.choice(["", "2023-01-10", "2023-03-01"])
            meetings.append((sid, m, f"type{m}", rng.sample(["MON", "TUE", "WED"], rng.randint(1, 2)),
                             f"{start // 60:02d}:{start % 60:02d}", f"{end // 60:02d}:{end % 60:02d}", low, "",
                             rng.random() < 0.1, rng.random() < 0.1))
    s = spark.createDataFrame(sections, "section_id string, term string, crn string, subject string, number string, "
                              "section_number string, start_date string, end_date string")
    m = spark.createDataFrame(meetings, "section_id string, meeting_index int, meeting_type string, weekdays array<string>, "
                              "start_time string, end_time string, start_date string, end_date string, is_arranged boolean, is_tba boolean")
    return sections, meetings, s, m


def minutes(text):
    return int(text[:2]) * 60 + int(text[3:])


def test_overlap_counts_match_brute_force(spark):
    rng = random.Random(5)
    rows = [("t", "MON" if rng.random() < 0.8 else "TUE", start, start + rng.choice([1, 15, 20, 50, 300]))
            for start in (rng.choice([0, 15, 600, rng.randint(0, 900)]) for _ in range(150))]
    want = {}
    for i, x in enumerate(rows):
        place = want.setdefault((x[1], x[2] // 15), [0, 0, 0])
        place[0] += 1
        place[2] += sum(y[1] == x[1] and (y[2], j) < (x[2], i) and y[3] > x[2] for j, y in enumerate(rows))
    for (day, bucket), place in want.items():
        place[1] = sum(y[1] == day and y[2] // 15 <= bucket <= (y[3] - 1) // 15 for y in rows)
    slots = spark.createDataFrame(rows, "term string, day string, start_min int, end_min int")
    got = {(r["day"], r["bucket"]): [r["starts"], r["covering"], r["overlaps"]] for r in records(C.overlap_counts(slots))}
    assert got == want
    assert C.overlap_counts(slots.limit(0)).isEmpty()


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 3, "bucket_minutes": 40}, {"block_rows": 2, "broadcast_rows": 0}])
def test_conflicts_match_brute_force(spark, sizes):
    sections, meetings, s, m = random_timetable(spark)
    owner = {row[0]: row for row in sections}
    want = {}
    for a in meetings:
        for b in meetings:
            if not a[0] < b[0] or owner[a[0]][1] != owner[b[0]][1] or a[8] or a[9] or b[8] or b[9]:
                continue
            dates = [(x[6] or owner[x[0]][6], x[7] or owner[x[0]][7]) for x in (a, b)]
            if not all(dates[0] + dates[1]):
                continue
            low, high = max(dates[0][0], dates[1][0]), min(dates[0][1], dates[1][1])
            shared = min(minutes(a[5]), minutes(b[5])) - max(minutes(a[4]), minutes(b[4]))
            if low > high or shared <= 0:
                continue
            for day in set(a[3]) & set(b[3]):
                want.setdefault((a[0], b[0], day, a[4], a[5], b[4], b[5], low, high), (shared, a[2], b[2]))
    got = {}
    for e in records(C.conflict_edges(s, m, **sizes)):
        key = tuple(e[c] for c in ("section_id_a", "section_id_b", "day", "start_time_a", "end_time_a",
                                   "start_time_b", "end_time_b", "date_start", "date_end"))
        assert key not in got
        got[key] = (e["overlap_minutes"], e["meeting_type_a"], e["meeting_type_b"])
    assert got == want and len(want) > 300


def test_conflict_join_broadcasts_no_slots(spark):
    _, _, s, m = random_timetable(spark)
    plan = C.conflict_edges(s, m)._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [line for line in plan if "Join" in line and "late_block" in line.split("], [")[0]]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_quality_rows_and_gate(spark, parsed):
    _, tables = parsed
    gaps = {r["section_id"]: r["missing"] for r in records(S.missing_fields(tables["sections"], tables["meetings"]))}
    assert set(map(tuple, gaps.values())) == {()}
    fetches = spark.createDataFrame(
        [("2023-fall", "CS", "blocked", "403", ""), ("2023-fall", "CS", "cache", "200", "h1"), ("2022-fall", "CS", "http_error", "500", "")],
        "term string, subject string, status string, http_status string, sha256 string")
    rows = {r["term"]: r for r in records(S.quality_rows(fetches, {k: v for k, v in tables.items() if k != "courses"}))}
    assert rows["2023-fall"]["acquisition_status"] == "cache" and rows["2023-fall"]["verified"]
    assert rows["2023-fall"]["source_rows"] == 18 and rows["2023-fall"]["http_status"] == "200;403"
    assert rows["2022-fall"]["acquisition_status"] == "http_error" and not rows["2022-fall"]["verified"]
    quality = S.quality_rows(fetches, {k: v for k, v in tables.items() if k != "courses"})
    edges = C.conflict_edges(tables["sections"], tables["meetings"])
    assert records(S.schedule_gate(quality, edges))[0]["verified"]
    for q, e, word in ((quality.limit(0), edges, "No quality"), (quality.where("not verified"), edges, "No target"), (quality, edges.limit(0), "no reproducible")):
        gate = records(S.schedule_gate(q, e))[0]
        assert not gate["verified"] and word in gate["reason"]


def test_clock_forms(spark):
    want = {
        "12 AM": "00:00", "12:30 a.m.": "00:30", "12 pm": "12:00", "12:59 P.M.": "12:59", "0:05 pm": "12:05", "1:05pm": "13:05",
        "11:59 PM": "23:59", "13:00 AM": "13:00", "13:00 PM": None, "23:59": "23:59", "24:00": None, "9": "09:00", "9:5": None,
        "9:60": None, "09:30": "09:30", "TBA": None, "ARR": None, "": None, " 7 AM ": "07:00", "noon": None, "1:05:00": None, None: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in want.items()], "t string, v string")
    rows = df.select("t", "v", txt.clock_time(F.col("t")).alias("got"), txt.minutes_of_day(F.col("v")).alias("m")).collect()
    assert {r["t"]: r["got"] for r in rows} == want
    assert all(r["m"] == (None if r["v"] is None else minutes(r["v"])) for r in rows)
    odd = spark.createDataFrame([("9:30",), (" 09:30 ",), ("09:30:00",)], "v string").select(txt.minutes_of_day(F.col("v")))
    assert [r[0] for r in odd.collect()] == [None, 570, None]


@pytest.mark.parametrize("parse, once", [(txt.clock_time, 1), (txt.iso_date, 1), (txt.weekday_list, 3)])
def test_texts_in_arrays_are_stripped_once(spark, parse, once):
    rows = spark.createDataFrame([([" 1:05 pm ", None, "TTh", "1/2/2023"],)], "texts array<string>").select(F.transform("texts", parse).alias("t"))
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == once


def test_missing_fields_in_order(spark):
    s = spark.createDataFrame([("x", "t", "CS", "1", "9", "", "1", "2023-01-01", None, None, None)],
                              "section_id string, term string, subject string, number string, crn string, section_number string, "
                              "part_of_term string, start_date string, end_date string, credit_min double, credit_max double")
    m = spark.createDataFrame([("x", 1, [], None, "10:00", "", False, False), ("x", 0, ["MON"], "09:00", None, "1", False, False), ("x", 2, [], None, None, "", True, False)],
                              "section_id string, meeting_index int, weekdays array<string>, start_time string, end_time string, room string, is_arranged boolean, is_tba boolean")
    assert records(S.missing_fields(s, m))[0]["missing"] == [
        "section.section_number", "section.end_date", "section.credit", "meeting.0.end_time",
        "meeting.1.weekdays", "meeting.1.start_time", "meeting.1.room"]


def test_text_parsers(spark):
    rows = [("TTh", "1:05 pm", "3 TO 4 hours", "8/1/2023", "cs 101a"), ("MWF", "12 AM", "none", "2023-08-01T00", "Math220"),
            ("arr", "13:00 PM", "", "soon", "101"), ("S.U, M", "25:00", None, None, None), (None, "tba", "2.5", "", "TOOLONGX 1")]
    df = spark.createDataFrame(rows, "d string, t string, c string, e string, n string")
    low, high, text = txt.credit_bounds(F.col("c"))
    subject, number = txt.subject_number(F.col("n"))
    got = df.select(txt.weekday_list(F.col("d")), txt.clock_time(F.col("t")), low, high, text, txt.iso_date(F.col("e")), subject, number).collect()
    assert [tuple(r) for r in got] == [
        (["TUE", "THU"], "13:05", 3.0, 4.0, "3 TO 4 hours", "2023-08-01", "CS", "101A"),
        (["MON", "WED", "FRI"], "00:00", None, None, "none", "2023-08-01", "MATH", "220"),
        ([], None, None, None, "", "soon", "", ""),
        (["SAT", "SUN", "MON"], None, None, None, "", "", "", ""),
        ([], None, 2.5, 2.5, "2.5", "", "", ""),
    ]
