"""Every stage of the pipeline, and all of them in a row, against plain versions on a small table."""

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termgrid.llm import language, mixing, queries
from test_operators import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    rows = sorted(given.where("length(text) < 2500").collect())[:120]
    text, (one, other) = next(r.text for r in rows if len(r.text) > 300), sorted({r.lang for r in rows if r.lang})[:2]
    extra = [(10**6, None, "en", "web", 0), (10**6 + 1, "12 34 !!", "en", "web", 8), (10**6 + 2, text, one, "web", 0),
             (10**6 + 5, text, other, "web", 0), (10**6 + 3, text, None, None, 0), (10**6 + 4, "Ms Ana Gil wrote to a.b@mail.example.com. Ana Gil said so", "en", "web", 0), tuple(rows[5])]
    return spark.createDataFrame([tuple(r) for r in rows] + extra, COLUMNS)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()), key=str)


def test_language_stage(spark, docs):
    out = corpus_pipeline.identify_language(spark, docs, "")
    found = language.predict(docs, language.fit(language.learnable(docs))).collect()
    want = sorted(((r.doc_id, r.text, r.lang_pred, r.source) for r in found if re.search(r"[^\W\d_]", r.text or "")), key=str)
    assert rows(out) == want and out.columns == docs.columns
    # one text under two labels and none has one language
    assert len({r[2] for r in rows(out) if r[0] in (10**6 + 2, 10**6 + 3, 10**6 + 5)} - {None}) == 1


def test_near_duplicates_stage(spark, docs):
    out = rows(corpus_pipeline.drop_near_duplicates(spark, docs, ""))
    given = rows(docs)
    groups = brute_components([(i, t) for i, (_, t, _, _) in enumerate(given)], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    least = {}
    for i, _, root in groups:
        key = ("alone", given[i][:2]) if root is None else root
        least[key] = min(least.get(key, given[i][0]), given[i][0])
    assert [r[0] for r in out] == sorted(least.values(), key=str) and set(out) <= set(given)


def test_personal_data_stage(spark, docs):
    out = corpus_pipeline.replace_personal_data(spark, docs, "").collect()
    mail = re.compile(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+")
    real = {m for r in docs.collect() for m in mail.findall(r.text or "")}
    assert len(out) == docs.count() and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    assert real and not any(m in real for r in out for m in mail.findall(r.text or ""))
    named = next(r.text for r in out if r.doc_id == 10**6 + 4)
    assert "Ana" not in named and "Gil" not in named


def test_mixing_stage(spark, docs):
    want = Counter()
    for r in mixing.with_mix(docs).collect():
        want[r.doc_id, r.text, r.lang, r.source] += r.copies
    assert Counter(rows(corpus_pipeline.mix_sources(spark, docs, ""))) == +want


def test_tokens_stage(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    texts = {r.doc_id: r.text for r in docs.where("text is not null").collect()}
    for r in corpus_pipeline.encode_tokens(spark, docs.where("text is not null"), "").collect():
        assert r.ids == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.exact


def test_run_is_its_stages_in_a_row(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, spark.createDataFrame(step.collect(), step.schema), "")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in got) == Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in step.collect())
    assert got and all(r.exact for r in got)
