"""Registered queries of the operators and their SQL.

Each query takes (spark, sf_dir) and applies its operator to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termgrid.llm import ann, ballcodes, bpe, conversations, jaccard, language, licenses, mips, mixing, packing, substrings, surrogates, urls

VOCABULARY = "byte_bpe_50k.json"  # the vocabulary of byte_bpe_50k.tiktoken in the tokenizers library's form
ALLOW_URLS = ("example.net/en/", "org/fr/")
BLOCK_URLS = ("net/", "example.com/de/")
SURROGATE_KEY = "termgrid"  # a real run passes a secret of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substrings.dedup_substrings(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text", "detections")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY)).drop("text")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, ALLOW_URLS, BLOCK_URLS).drop("url")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.with_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(language.learnable(docs))
    found = language.predict(docs.select("doc_id", "text", language.held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_KEY)


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ballcodes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.summarize(rows.select("conv_id"), conversations.damaged(rows))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", *packing.OUTPUTS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard, op2_substrings, op3_licenses, op4_ann, op5_top_products, op6_bpe, op7_urls, op8_mixing, op9_language, op10_surrogates, op11_ball_codes, op12_conversations, op13_packing)}


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


OP5_SQL = r"""
WITH sound AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _op11_sql(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Plain k-means on all pairs of a part and an entry, a few CTEs a round."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), pieces AS (
  SELECT n, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS t(p)
), book0 AS (SELECT p, n - 1 AS e, x AS c FROM pieces WHERE n <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
  SELECT n, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
  FROM pieces JOIN book{r} USING (p) GROUP BY n, p
)""")
        if r < rounds:
            steps.append(f"""
means{r} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, best.e AS e, i, CAST(floor(sum(x[i + 1])::DOUBLE / count(*)) AS BIGINT) AS m
    FROM near{r} JOIN pieces USING (n, p), range(64) AS t(i) WHERE i < len(x) GROUP BY p, best.e, i
  ) GROUP BY p, e
), book{r + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN means{r} m USING (p, e))""")
    steps.append(f"""
coded AS (
  SELECT n, CAST(sum(best.d) AS BIGINT) AS error, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code FROM near{rounds} GROUP BY n
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (n), digest""")
    return "WITH " + ",".join(steps[:-1]) + "," + steps[-1]


def oracle_sql() -> dict[str, str]:
    return {"op5_top_products": OP5_SQL, "op7_urls": OP7_SQL, "op11_ball_codes": _op11_sql()}
