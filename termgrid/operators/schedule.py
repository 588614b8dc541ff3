"""Quality evidence of the timetable tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgrid.functions.text import joined

# Fields a section must have, in report order.
CRITICAL_SECTION_FIELDS = (
    "term", "subject", "number", "crn", "section_number", "part_of_term", "start_date", "end_date",
)
# Fetch results, best first.
STATUS_ORDER = ("ok", "cache", "blocked", "http_error", "network_error")
# Why timetable results are not shown.
NO_REPORT = "No quality report exists."
NOT_VERIFIED = "No target term has verified acquisition and normalized data."
NO_EDGES = "Verified data exist, but no reproducible conflict edges are present."


def _blank(name: str):
    return F.coalesce(F.col(name), F.lit("")) == ""


def _section_gaps() -> Column:
    """Critical fields that a section row lacks."""
    return F.array_compact(F.array(
        *[F.when(_blank(f), F.lit(f"section.{f}")) for f in CRITICAL_SECTION_FIELDS],
        F.when(F.col("credit_min").isNull() & F.col("credit_max").isNull(), F.lit("section.credit")),
    ))


def _meeting_gaps(m, index: Column) -> Column:
    """Critical fields that a meeting lacks; ``m`` gives its fields by name."""
    checks = {
        "weekdays": F.coalesce(F.size(m["weekdays"]), F.lit(0)) <= 0,
        **{f: F.coalesce(m[f], F.lit("")) == "" for f in ("start_time", "end_time", "room")},
    }
    prefix = F.concat(F.lit("meeting."), index.cast("string"), F.lit("."))
    scheduled = ~m["is_arranged"] & ~m["is_tba"]
    return F.array_compact(F.array(*[F.when(scheduled & bad, F.concat(prefix, F.lit(f))) for f, bad in checks.items()]))


def missing_fields(sections: DataFrame, meetings: DataFrame) -> DataFrame:
    """Sections with the list of critical fields they or their meetings lack."""
    columns = {c: F.col(c) for c in meetings.columns}
    bad_meetings = meetings.select(
        "section_id", "meeting_index", _meeting_gaps(columns, F.col("meeting_index")).alias("issues")).where(F.size("issues") > 0)
    per_section = bad_meetings.groupBy("section_id").agg(
        F.array_sort(F.collect_list(F.struct("meeting_index", "issues"))).alias("found")
    ).select("section_id", F.flatten(F.transform("found", lambda m: m["issues"])).alias("meeting_issues"))
    joined_rows = sections.join(per_section, "section_id", "left")
    none = F.array().cast("array<string>")
    return joined_rows.select(
        "section_id", "term", "subject",
        F.concat(_section_gaps(), F.coalesce("meeting_issues", none)).alias("missing"),
    )


def missing_entries(sections: DataFrame, meetings: DataFrame) -> DataFrame:
    """(section_id, meeting_index, field, term, subject): a row per missing critical field, so no section's list is ever held whole.

    The index is -1 for the section's own fields.
    """
    columns = {c: F.col(c) for c in meetings.columns}
    of_meetings = meetings.select("section_id", "meeting_index", F.explode(_meeting_gaps(columns, F.col("meeting_index"))).alias("field"))
    of_meetings = of_meetings.join(sections.select("section_id", "term", "subject"), "section_id")
    of_sections = sections.select("section_id", F.lit(-1).alias("meeting_index"), F.explode(_section_gaps()).alias("field"), "term", "subject")
    return of_sections.unionByName(of_meetings)


def parsed_evidence(courses: DataFrame, sections: DataFrame) -> DataFrame:
    """(term, subject, source_rows, fields) for every section of every document, as read, before copies are dropped.

    ``courses`` and ``sections`` are a row per document and per section, as
    ``sources.documents.parsed_tables`` gives them.
    """
    gaps = F.transform("meetings", lambda m, i: _meeting_gaps(m, i))
    rows = F.when(F.col("section_pos").isNull(), 0).otherwise(1 + F.size("meetings") + F.size("people") + F.size("gened"))
    fields = F.when(F.col("section_pos").isNull(), F.array().cast("array<string>")).otherwise(F.concat(_section_gaps(), F.flatten(gaps)))
    of_sections = sections.select("term", "subject", rows.cast("long").alias("source_rows"), fields.alias("fields"))
    return of_sections.unionByName(courses.where("prerequisite_text <> ''").select(
        "term", "subject", F.lit(1).cast("long").alias("source_rows"), F.array().cast("array<string>").alias("fields")))


def quality_rows(
    records: DataFrame, tables: Mapping[str, DataFrame], parsed: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Evidence per term and subject from fetch records, documents and normalised tables.

    ``tables`` holds sections, meetings, instructors, gened and prerequisites.
    With ``parsed`` (courses and sections as read) source rows, missing fields and
    the list of subjects come from the documents, every copy counted, and the
    tables only say how many rows were kept; without, the tables are the source.
    All inputs are reduced to (term, subject) before they meet in one grouping.
    """
    key = ("term", "subject")
    null = F.lit(None)
    shape = {
        "best": null.cast("int"), "http_status": null.cast("string"), "sha256": null.cast("string"),
        "source": null.cast("long"), "kept": null.cast("long"), "field": null.cast("string"),
    }

    def shaped(df: DataFrame, **columns) -> DataFrame:
        return df.select(*key, *[columns.get(c, default).alias(c) for c, default in shape.items()])

    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status")).cast("int")
    parts = [shaped(
        records, best=F.when(rank > 0, rank), http_status=F.col("http_status"), sha256=F.col("sha256")
    )]
    for df in tables.values():
        sizes = df.groupBy(*key).count()
        parts.append(shaped(sizes, kept=F.col("count"), **({} if parsed else {"source": F.col("count")})))
    if parsed:
        # one pass: a term and subject's rows, and once more with every missing field
        grouped = parsed_evidence(*parsed).select(*key, "source_rows", F.explode(F.concat(
            F.array(F.struct(F.lit(None).cast("string").alias("field"), F.col("source_rows").alias("source"))),
            F.transform("fields", lambda f: F.struct(f.alias("field"), F.lit(0).cast("long").alias("source"))),
        )).alias("e")).groupBy(*key, "e.field").agg(F.sum("e.source").alias("source"))
        parts.append(shaped(grouped, source=F.col("source"), field=F.col("field")))
    else:
        gaps = missing_entries(tables["sections"], tables["meetings"]).select(*key, "field").distinct()
        parts.append(shaped(gaps, field=F.col("field")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    grouped = union.groupBy(*key).agg(
        F.min("best").alias("best"),
        joined(F.collect_set("http_status"), ";").alias("http_status"),
        joined(F.collect_set("sha256"), ";").alias("file_hashes"),
        F.coalesce(F.sum("source"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("kept_rows"),
        joined(F.collect_set("field"), ";").alias("missing_critical_fields"),
    )
    status = F.coalesce(F.get(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("best") - 1), F.lit("missing"))
    return grouped.select(
        *key, status.alias("acquisition_status"), "http_status", "file_hashes", "source_rows",
        F.col("source_rows").alias("normalized_rows"), "kept_rows", "missing_critical_fields",
        (status.isin("ok", "cache") & (F.col("source_rows") > 0) & (F.col("missing_critical_fields") == "")).alias("verified"),
    )


def schedule_gate(quality: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: may timetable results be shown, and if not, why."""
    seen = quality.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("verified").alias("verified_rows")
    ).withColumn("_k", F.lit(1))
    some_edge = edges.limit(1).agg(F.count(F.lit(1)).alias("edges")).withColumn("_k", F.lit(1))
    reason = (
        F.when(F.col("rows") == 0, NO_REPORT)
        .when(F.col("verified_rows") == 0, NOT_VERIFIED)
        .when(F.col("edges") == 0, NO_EDGES)
        .otherwise("")
    )
    return seen.join(some_edge, "_k").select((reason == "").alias("verified"), reason.alias("reason"))
