"""Evidence about stored source files and fetched resources.

Fetching itself is no Spark work and is not built; stored responses are tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termgrid.functions.text import term_name
from termgrid.operators.normalize import year_number
from termgrid.spec import PanelSpec

# Texts of the failure records.
CHALLENGED = "WAF challenge or 202 accepted; no XML returned"
EMPTY, HTML, INVALID = "empty body", "HTML body instead of XML", "invalid XML"
OFFLINE = "live acquisition disabled; cache miss"
REFUSED = "; WAF/rate-limit/block evidence preserved; no bypass attempted"

PIECE = 8 << 20  # bytes of a file that a task holds while it hashes it


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files as (path, content); a file must fit one row, so one beyond 2 GB raises (``hashed_files`` takes any size)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def file_manifest(files: DataFrame) -> DataFrame:
    """Hash and size of every stored file or response body."""
    return files.select(
        "path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
        F.octet_length("content").cast("long").alias("bytes"),
    )


def hashed_files(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """Hash and size of stored files of any size, without a row that holds one.

    Spark lists the files (their contents are no column of the scan, so nothing is
    read); each is then streamed once through a running digest, ``piece`` bytes at
    a time.  A digest is a sequential function of the bytes, so one file is the
    work of one task; files are dealt over all cores.  Local paths and the schemes
    that Arrow's file systems open (hdfs, s3, gs) are read; others raise.
    Spark's scans list no empty files, so these have no row (nor in ``read_files``).
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                digest, size = _digest(name, piece)
                yield pa.RecordBatch.from_pydict({"path": [name], "sha256": [digest], "bytes": [size]})

    return listed.repartition(tasks, "path").select("path").mapInArrow(hashed, "path string, sha256 string, bytes long")


def _digest(name: str, piece: int) -> tuple[str, int]:
    """The running sha256 of one file, and the bytes it was taken over."""
    if name.startswith("file:"):  # Spark writes file:/a b, unescaped
        store, inner = fs.LocalFileSystem(), "/" + name.removeprefix("file:").lstrip("/")
    else:
        store, inner = fs.FileSystem.from_uri(quote(name, safe=":/@"))
    digest, size = hashlib.sha256(), 0
    with store.open_input_stream(inner) as stream:
        while part := stream.read(piece):
            digest.update(part)
            size += len(part)
    return digest.hexdigest(), size


def source_coverage(raw: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
    """One row: record count, sorted distinct years and terms as text.

    The rows are reduced to distinct (year, term) pairs first.
    """
    raw = (spec or PanelSpec()).canonical(raw)
    pairs = raw.groupBy(year_number(raw).cast("int").alias("year"), term_name(F.col("term")).alias("term")).count()
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ",")
    return pairs.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("record_count"),
        text("year").alias("years"), text("term").alias("terms"),
    )


def looks_like_html(body: Column, content_type: Column) -> Column:
    head = F.lower(F.substring(F.regexp_replace(body.cast("string"), r"^\s+", ""), 1, len("<!doctype html")))
    typed = F.coalesce(F.lower(content_type).contains("html"), F.lit(False))
    return typed | F.coalesce(head.startswith("<!doctype html") | head.startswith("<html"), F.lit(False))


def is_readable_xml(body: Column) -> Column:
    parsed = F.from_xml(body.cast("string"), "_any string, _corrupt_record string", {"mode": "PERMISSIVE"})
    return parsed.isNotNull() & parsed["_corrupt_record"].isNull()


def probe_errors(responses: DataFrame) -> DataFrame:
    """Why a probe for an XML document failed; '' for a usable document.

    Columns: url, status, header_action, content_type, body.
    """
    status, body = F.col("status"), F.col("body")
    error = (
        F.when((status == 202) | (F.col("header_action") == "challenge"), CHALLENGED)
        .when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
        .when(F.coalesce(F.octet_length(body), F.lit(0)) == 0, EMPTY)
        .when(looks_like_html(body, F.col("content_type")), HTML)
        .when(~is_readable_xml(body), INVALID)
        .otherwise("")
    )
    return responses.select("url", "status", error.alias("error"))


def fetch_records(responses: DataFrame, allow_live: bool = True) -> DataFrame:
    """Fetch result per stored response: ok, cache, blocked, http_error or network_error, with the error's text.

    Columns: url, status (null when the network failed), from_cache, body, and
    optionally failure, the network's own message.  Without live access every
    response that no cache holds counts as blocked, whatever its status says.
    """
    code, cached = F.col("status").cast("string"), F.coalesce(F.col("from_cache"), F.lit(False))
    failure = F.coalesce(F.col("failure"), F.lit("")) if "failure" in responses.columns else F.lit("")
    offline = F.lit(not allow_live)
    status = (
        F.when(cached, "cache")
        .when(offline, "blocked")
        .when(code.isNull(), "network_error")
        .when(code == "200", "ok")
        .when(code.isin("401", "403", "429"), "blocked")
        .otherwise("http_error")
    )
    usable = status.isin("ok", "cache")
    return responses.select(
        *[c for c in responses.columns if c not in ("status", "body", "from_cache", "failure")],
        status.alias("status"),
        F.when(cached, F.coalesce(code, F.lit("cache"))).when(offline, "").otherwise(F.coalesce(code, F.lit(""))).alias("http_status"),
        F.when(usable, F.sha2(F.col("body").cast("binary"), 256)).otherwise("").alias("sha256"),
        F.when(usable, F.octet_length("body").cast("long")).otherwise(0).alias("bytes"),
        F.when(usable, "").when(offline, OFFLINE).when(code.isNull(), failure)
        .otherwise(F.concat(F.lit("HTTP "), code, F.lit(REFUSED))).alias("error"),
    )


def combined_manifest(requested: DataFrame, files: DataFrame, failures: DataFrame) -> DataFrame:
    """Requested, stored and failed resources per source."""
    parts = [
        df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        for kind, df in (("requested", requested), ("files", files), ("failures", failures))
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    rows = union.groupBy("source").agg(count("requested"), count("files"), count("failures"))
    return rows.withColumn("complete", F.col("failures") == 0)


def require_complete(manifest: DataFrame, allow_partial: bool = False) -> None:
    if not allow_partial and not manifest.where("not complete").isEmpty():
        raise RuntimeError("acquisition is incomplete")
