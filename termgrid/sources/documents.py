"""XML course documents of any layout -> six normalised tables, as a corpus job.

Each document becomes one row with its elements in document order: depth, parent,
last descendant, tag without namespace, ids and text (``element_rows``, the only
step outside the JVM: it keeps what an XML schema loses, which is the order of
elements of different names and tags nobody expected).  As elements are numbered
in order, an element's descendants are a slice of the array, so courses, sections,
meetings and instructors are found at any depth with array expressions, inside
the row and without a join.

``parse_documents`` gives a row per document, ``section_rows`` a row per section
with its meetings, instructors and attributes; the tables are cut from these, and
only the last-wins choice between documents shuffles.  That is an aggregation
(``max_by``), so a course with very many copies does not land in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgrid.functions.text import (
    clock_time, course_id, credit_bounds, iso_date, section_id, strip, subject_number, weekday_list,
)
from termgrid.sources.scratch import materialize

XML_OPTIONS = {"rowTag": "course", "ignoreNamespace": "true", "mode": "PERMISSIVE"}
ELEMENT = "struct<at:int,depth:int,parent:int,last:int,tag:string,id:string,href:string,text:string>"
ROWS = 64  # documents handed back at a time

# Tags whose text a table takes, by the element they are direct children of.
COURSE_TAGS = ("title", "courseTitle", "description", "creditHours", "prerequisites", "prerequisite")
SECTION_TAGS = ("crn", "callNumber", "sectionNumber", "section", "partOfTerm", "partOfTermCode", "startDate", "endDate", "creditHours")
MEETING_TAGS = (
    "type", "meetingType", "days", "day", "start", "startTime", "end", "endTime", "building", "buildingName", "room", "roomNumber",
    "startDate", "endDate",
)
INSTRUCTOR_TAGS = ("name", "instructorName", "email", "role")
# Tags whose text counts at any depth.
ANYWHERE_TAGS = ("name", "subject", "number", "title", "description", "prerequisites", "genEdAttribute", "instructor")


def read_documents(spark: SparkSession, path: str, term: str) -> DataFrame:
    """One row per file: term, document order (path), XML text."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.lit(term).alias("term"), F.col("_metadata.file_path").alias("doc_order"), F.col("value").alias("xml"))


def elements_of(xml: str, out: Mapping[str, list]) -> int:
    """Adds the elements of one document, in order, to the columns of ``out`` and gives their number.

    Raises ElementTree.ParseError for a document that isn't well-formed, before anything is added.
    """
    at, depth, parent, last, tag, id_, href, text = out.values()
    start = len(at)
    open_, missing = [], []  # the elements around the next one, and how many children of each are still to come
    n = 0
    for element in ElementTree.fromstring(xml).iter():
        while missing and not missing[-1]:
            missing.pop()
            last[start + open_.pop()] = n - 1
        if missing:
            missing[-1] -= 1
        at.append(n)
        depth.append(len(open_))
        parent.append(open_[-1] if open_ else -1)
        last.append(n)
        name = element.tag
        tag.append(name.rsplit("}", 1)[-1] if "}" in name else name)
        id_.append(element.get("id"))
        href.append(element.get("href"))
        text.append(element.text)
        children = len(element)
        if children:
            open_.append(n)
            missing.append(children)
        n += 1
    for opened in open_:
        last[start + opened] = n - 1
    return n


def element_rows(docs: DataFrame) -> DataFrame:
    """(term, doc_order, error, nodes): the elements of every document, or why it can't be read."""
    fields = [docs.schema["term"], docs.schema["doc_order"]]
    schema = T.StructType([*fields, T.StructField("error", T.StringType()), T.StructField("nodes", T._parse_datatype_string(f"array<{ELEMENT}>"))])
    kinds = {"at": pa.int32(), "depth": pa.int32(), "parent": pa.int32(), "last": pa.int32(), **dict.fromkeys(("tag", "id", "href", "text"), pa.string())}

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                columns = {name: [] for name in kinds}
                errors, starts, total = [], [], 0
                for xml in rows.column("xml").to_pylist():
                    error, size = None if xml is not None else "no document", 0
                    try:
                        size = elements_of(xml, columns) if xml is not None else 0
                    except ElementTree.ParseError as problem:
                        error = str(problem)
                    errors.append(error)
                    starts.append(total if error is None else None)  # no start: no list
                    total += size
                nodes = pa.StructArray.from_arrays([pa.array(columns[name], kind) for name, kind in kinds.items()], list(kinds))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("term"), rows.column("doc_order"), pa.array(errors, pa.string()),
                     pa.ListArray.from_arrays(pa.array([*starts, total], pa.int32()), nodes)],
                    ["term", "doc_order", "error", "nodes"],
                )

    return docs.select("term", "doc_order", "xml").mapInArrow(run, schema)


def subject_references(spark: SparkSession, path: str) -> DataFrame:
    """Course id and link of every course in the subject index files; both required."""
    files = spark.read.text(path, wholetext=True).select(F.lit("").alias("term"), F.col("_metadata.file_path").alias("doc_order"), F.col("value").alias("xml"))
    return subject_references_of(files)


def subject_references_of(docs: DataFrame) -> DataFrame:
    """The same for index documents held in a column ``xml``: courses at any depth, named by id or by the first name below them."""
    given = [F.col(c) if c in docs.columns else F.lit("").alias(c) for c in ("term", "doc_order")]
    nodes = F.col("nodes")
    courses = F.transform(F.filter(nodes, lambda n: n["tag"] == "course"), lambda c: F.struct(
        _given(c["id"], _anywhere(_below(nodes, c), "name")).alias("id"), F.coalesce(c["href"], F.lit("")).alias("href")))
    refs = element_rows(docs.select(*given, "xml")).where("error is null").select(F.inline(courses))
    return refs.where("id <> '' and href <> ''")


def _text(node: Column) -> Column:
    return F.coalesce(strip(node["text"]), F.lit(""))


def _given(attribute: Column, otherwise: Column) -> Column:
    return F.when(F.coalesce(attribute, F.lit("")) != "", attribute).otherwise(otherwise)


def _below(nodes: Column, node: Column, base: Column | int = 0) -> Column:
    """An element and its descendants; ``base`` is the number of the array's first element."""
    return F.slice(nodes, node["at"] - base + 1, node["last"] - node["at"] + 1)


def _child(nodes: Column, node: Column, *names: str) -> Column:
    """Text of the first child with one of the names, blank if that child is; '' without one."""
    return F.coalesce(_text(F.get(F.filter(nodes, lambda n: (n["parent"] == node["at"]) & n["tag"].isin(*names)), F.lit(0))), F.lit(""))


def _anywhere(nodes: Column, name: str) -> Column:
    """The first text of that name that isn't blank, at any depth; '' without one."""
    return F.coalesce(_text(F.get(F.filter(nodes, lambda n: (n["tag"] == name) & (_text(n) != "")), F.lit(0))), F.lit(""))


def _texts(nodes: Column, tag: str) -> Column:
    found = F.transform(F.filter(nodes, lambda n: n["tag"] == tag), _text)
    return F.array_distinct(F.filter(found, lambda t: t != ""))


def _first_of(*texts: Column) -> Column:
    return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(""))


def parse_documents(docs: DataFrame) -> DataFrame:
    """Course fields and the course's elements, one row per readable document.

    ``docs`` has ``term``, ``doc_order`` (sortable, later wins) and ``xml``.  The
    course is the root or, below another root, its first child of that name.
    Unreadable documents are left to ``unreadable_documents``.
    """
    all_nodes = F.col("all_nodes")
    wrapped = F.array_position(F.transform(all_nodes, lambda n: (n["depth"] == 1) & (n["tag"] == "course")), True)
    rows = element_rows(docs).where("error is null").withColumnRenamed("nodes", "all_nodes")
    rows = rows.withColumn("root", F.get(all_nodes, F.when(all_nodes[0]["tag"] == "course", 0).otherwise(F.greatest(wrapped - 1, F.lit(0))).cast("int")))
    rows = rows.select("term", "doc_order", "root", _below(all_nodes, F.col("root")).alias("nodes"))
    nodes, root = F.col("nodes"), F.col("root")
    subject, number = subject_number(_given(root["id"], _anywhere(nodes, "name")))
    holders = F.filter(nodes, lambda n: (n["parent"] == root["at"]) & (n["tag"] == "genEdAttributes"))
    inside = F.flatten(F.transform(holders, lambda h: _texts(_below(nodes, h, root["at"]), "genEdAttribute")))
    direct = _texts(F.filter(nodes, lambda n: n["parent"] == root["at"]), "genEdAttribute")
    rows = rows.select(
        "term", "doc_order", "nodes", root["at"].alias("base"),
        F.when(subject != "", subject).otherwise(F.upper(_anywhere(nodes, "subject"))).alias("subject"),
        F.when(number != "", number).otherwise(F.upper(_anywhere(nodes, "number"))).alias("number"),
        _first_of(_child(nodes, root, "title", "courseTitle"), _anywhere(nodes, "title")).alias("title"),
        _first_of(_child(nodes, root, "description"), _anywhere(nodes, "description")).alias("description"),
        _child(nodes, root, "creditHours").alias("credit_text"),
        _first_of(_child(nodes, root, "prerequisites", "prerequisite"), _anywhere(nodes, "prerequisites")).alias("prerequisite_text"),
        F.array_distinct(F.concat(inside, direct)).alias("course_gened"),
    )
    low, high, _ = credit_bounds(F.col("credit_text"))
    return rows.withColumns({"credit_min": low, "credit_max": high})


def unreadable_documents(docs: DataFrame) -> DataFrame:
    return element_rows(docs).where("error is not null").select("term", "doc_order")


def unmatched_elements(docs: DataFrame) -> DataFrame:
    """(term, parent_tag, tag, elements): elements with a text that no table takes, so that none is lost without a trace."""
    nodes = F.col("nodes")
    # what an element needs of the others is taken before it leaves its array
    parts = F.transform(F.filter(nodes, lambda n: _text(n) != ""), lambda n: F.struct(
        F.coalesce(F.get(nodes, n["parent"])["tag"], F.lit("")).alias("parent_tag"), n["tag"].alias("tag")))
    rows = element_rows(docs).where("error is null").select("term", F.inline(parts))
    known = reduce(lambda a, b: a | b, [
        (F.col("parent_tag") == owner) & F.col("tag").isin(*tags) for owner, tags in
        (("course", COURSE_TAGS), ("section", SECTION_TAGS), ("meeting", MEETING_TAGS), ("instructor", INSTRUCTOR_TAGS))
    ])
    return rows.where(~known & ~F.col("tag").isin(*ANYWHERE_TAGS)).groupBy("term", "parent_tag", "tag").agg(F.count("*").alias("elements"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order per key; map-side combined."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


COURSE_NAME = ("term", "subject", "number")
SECTION_NAME = (*COURSE_NAME, "crn", "section_id")


# Fields of a meeting and the tags that may hold them.
MEETING_FIELDS = {
    "type": ("type", "meetingType"), "days": ("days", "day"), "start": ("start", "startTime"), "end": ("end", "endTime"),
    "building": ("building", "buildingName"), "room": ("room", "roomNumber"), "from": ("startDate",), "to": ("endDate",),
}


def _meetings(nodes: Column, section_start: Column, section_end: Column) -> Column:
    """Meetings at any depth below a section, in document order."""
    # each meeting takes its children along and every text is looked up once among them; what follows is worked out on the found texts
    own = F.transform(F.filter(nodes, lambda n: n["tag"] == "meeting"), lambda m: F.struct(
        m.alias("node"), F.filter(_below(nodes, m, F.get(nodes, F.lit(0))["at"]), lambda n: n["parent"] == m["at"]).alias("children")))
    found = F.transform(own, lambda o: F.struct(
        *[_child(o["children"], o["node"], *tags).alias(name) for name, tags in MEETING_FIELDS.items()]))

    def judged(m: Column) -> Column:
        raw = [F.upper(m[c]) for c in ("days", "start", "end", "building", "room")]
        return F.struct(
            m.alias("m"), reduce(lambda a, b: a | b, [t.startswith("ARR") for t in raw[:3]]).alias("arranged"),
            reduce(lambda a, b: a | b, [t.isin("TBA", "TBD") for t in raw]).alias("tba"),
        )

    def finished(j: Column) -> Column:
        m, arranged = j["m"], j["arranged"]
        return F.struct(
            m["type"].alias("meeting_type"), m["days"].alias("days_raw"),
            F.when(arranged, F.array().cast("array<string>")).otherwise(weekday_list(m["days"])).alias("weekdays"),
            F.when(~arranged, clock_time(m["start"])).alias("start_time"), F.when(~arranged, clock_time(m["end"])).alias("end_time"),
            m["building"].alias("building"), m["room"].alias("room"),
            _first_of(iso_date(m["from"]), section_start).alias("start_date"), _first_of(iso_date(m["to"]), section_end).alias("end_date"),
            arranged.alias("is_arranged"), j["tba"].alias("is_tba"),
        )

    return F.transform(F.transform(found, judged), finished)


def _people(nodes: Column) -> Column:
    """Instructors at any depth below a section, each name once, in document order."""
    people = F.transform(F.filter(nodes, lambda n: n["tag"] == "instructor"), lambda p: F.struct(
        _first_of(_child(nodes, p, "name", "instructorName"), _text(p)).alias("name"),
        _child(nodes, p, "email").alias("email"), _child(nodes, p, "role").alias("role"),
    ))
    return F.filter(people, lambda p: p["name"] != "")


def section_rows(courses: DataFrame) -> DataFrame:
    """A row per section of every document, before copies are dropped: its fields, meetings, people and attributes.

    A document without sections has one row whose ``section_pos`` is null.
    """
    nodes = F.col("nodes")
    # each section takes its own slice along, not the document
    parts = F.transform(F.filter(nodes, lambda n: n["tag"] == "section"), lambda n: F.struct(
        n.alias("node"), _below(nodes, n, F.col("base")).alias("own")))
    rows = courses.select(
        "term", "doc_order", "subject", "number", "credit_text", "course_gened", F.posexplode_outer(parts).alias("section_pos", "part"))
    rows = rows.select("*", "part.node", F.coalesce("part.own", F.array().cast(f"array<{ELEMENT}>")).alias("own")).drop("part")
    node, own = F.col("node"), F.col("own")
    unknown = F.concat(F.lit("UNKNOWN-"), F.col("section_pos").cast("string"))
    rows = rows.withColumns({
        "crn": _given(node["id"], _first_of(_child(own, node, "crn", "callNumber"), unknown)),
        "start_date": iso_date(_child(own, node, "startDate")), "end_date": iso_date(_child(own, node, "endDate")),
        "section_credit": _first_of(_child(own, node, "creditHours"), F.col("credit_text")),
        "people": _people(own), "own_gened": _texts(own, "genEdAttribute"),
    })
    low, high, _ = credit_bounds(F.col("section_credit"))
    meetings = _meetings(own, F.col("start_date"), F.col("end_date"))
    names = F.array_distinct(F.transform("people", lambda p: p["name"]))
    return rows.select(
        *COURSE_NAME, "doc_order", "section_pos", "crn", section_id(*[F.col(c) for c in (*COURSE_NAME, "crn")]).alias("section_id"),
        course_id(*[F.col(c) for c in COURSE_NAME]).alias("course_id"),
        _child(own, node, "sectionNumber", "section").alias("section_number"),
        _child(own, node, "partOfTerm", "partOfTermCode").alias("part_of_term"),
        "start_date", "end_date", low.alias("credit_min"), high.alias("credit_max"), F.col("section_credit").alias("credit_text"),
        meetings.alias("meetings"),
        F.transform(names, lambda t: F.get(F.filter("people", lambda p: p["name"] == t), F.lit(0))).alias("people"),
        F.when(F.size("own_gened") > 0, F.col("own_gened")).otherwise(F.col("course_gened")).alias("gened"),
    )


def course_table(courses: DataFrame) -> DataFrame:
    rows = courses.select(
        course_id(*[F.col(c) for c in COURSE_NAME]).alias("course_id"), "doc_order", *COURSE_NAME,
        "title", "description", "credit_min", "credit_max", "credit_text",
    )
    return latest(rows, ["course_id"], ["doc_order"])


def section_table(sections: DataFrame) -> DataFrame:
    rows = sections.where("section_pos is not null").drop("meetings", "people", "gened")
    return latest(rows, ["section_id"], ["doc_order", "section_pos"])


def meeting_table(sections: DataFrame) -> DataFrame:
    rows = sections.select(*SECTION_NAME, "doc_order", "section_pos", F.posexplode("meetings").alias("meeting_index", "m"))
    return latest(rows.select(*[c for c in rows.columns if c != "m"], "m.*"), ["section_id", "meeting_index"], ["doc_order", "section_pos"])


def instructor_table(sections: DataFrame) -> DataFrame:
    """Instructors of a section, each name once, numbered in document order."""
    rows = sections.select(*SECTION_NAME, "doc_order", "section_pos", F.posexplode("people").alias("instructor_index", "p"))
    rows = rows.select(*[c for c in rows.columns if c != "p"], "p.*")
    return latest(rows, ["section_id", "instructor_index", "name"], ["doc_order", "section_pos"])


def gened_table(sections: DataFrame) -> DataFrame:
    """Attributes of a section; those of the course where it has none of its own."""
    rows = sections.where("section_pos is not null").select(*SECTION_NAME, F.explode("gened").alias("attribute_code"))
    # Rows of equal key are equal in every column, so distinct is last-wins here.
    return rows.distinct().withColumn("attribute_description", F.col("attribute_code"))


def prerequisite_table(courses: DataFrame) -> DataFrame:
    rows = courses.where("prerequisite_text <> ''").select(
        course_id(*[F.col(c) for c in COURSE_NAME]).alias("course_id"), "doc_order", *COURSE_NAME,
        "prerequisite_text",
    )
    return latest(rows, ["course_id"], ["doc_order"])


def parsed_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Courses and sections of all documents, parsed once and kept in the shared folder."""
    courses = materialize(parse_documents(docs), "documents")
    return courses, materialize(section_rows(courses), "document-sections")


def tables_of(courses: DataFrame, sections: DataFrame) -> dict[str, DataFrame]:
    return {
        "courses": course_table(courses), "sections": section_table(sections),
        "meetings": meeting_table(sections), "instructors": instructor_table(sections),
        "gened": gened_table(sections), "prerequisites": prerequisite_table(courses),
    }


def document_tables(docs: DataFrame) -> dict[str, DataFrame]:
    return tables_of(*parsed_tables(docs))
