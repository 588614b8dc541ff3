"""Every operator on the same awkward rows: no crash, all rows back, columns that share a working name untouched."""

import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from termgrid.llm import ballcodes, bpe, jaccard, language, licenses, mixing, packing, queries, substrings, surrogates, urls

VOCABULARY = public_tokenizers.path(queries.VOCABULARY)
NAMES = ("_n", "text_key", "_size", "_key", "_judged", "_new", "_names", "_unit", "_source", "_hits", "_rows", "_rank", "_part", "_at", "_codes")
LONG = ["x" * 1_000_000, "a@" + "b." * 20_000 + "com", "Mr A" + "a" * 1_000_000, "Mr " + "A'aa" * 5_000, "1" * 200_000, "- " * 50_000 + "token=" + "a" * 100_000]
SHORT = [None, "", " \n ", "plain words", "plain words", "Ms Ana Gil, a.b@c.example.com", "é" * 40]


@pytest.fixture(scope="module")
def rows(spark):
    texts = SHORT + LONG + ["same text of ten words again and again and again"] * 2_000
    df = spark.createDataFrame([(i, t, "en", None if i % 3 else "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.col("doc_id").alias(n) for n in NAMES]).repartition(4)


def found(name, df):
    return {
        "substrings": lambda: substrings.dedup_substrings(df), "licenses": lambda: licenses.scan_licenses(df),
        "bpe": lambda: bpe.round_trip(df, VOCABULARY), "encode": lambda: bpe.encode(df, VOCABULARY, exact=True),
        "urls": lambda: urls.filter_urls(df.withColumn("url", F.col("text")), ("a.org/",), ("net/",)),
        "mixing": lambda: mixing.with_mix(df), "surrogates": lambda: surrogates.replace_entities(df, "k"),
        "packing": lambda: packing.pack(df, VOCABULARY).where("piece = 0"),
        "language": lambda: language.predict(df, language.fit(language.learnable(df))),
    }[name]()


@pytest.mark.parametrize("name", ["substrings", "licenses", "bpe", "encode", "urls", "mixing", "surrogates", "packing", "language"])
def test_all_rows_come_back_with_their_columns(rows, name):
    wrong = F.lit(False)
    for c in NAMES:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col("doc_id"))
    got = found(name, rows).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.count_if(wrong).alias("wrong")).first()
    assert (got["n"], got["ids"], got["wrong"]) == (rows.count(), rows.count(), 0)


def test_jaccard_reads_only_its_columns(rows):
    assert jaccard.jaccard_components(rows).count() == rows.count()


def test_vectors_keep_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0], i % 2, i, i) for i in range(50)], "vec_id long, embedding array<float>, label int, _at int, _codes int")
    out = ballcodes.compress(df, parts=2, entries=4)
    assert {(r.vec_id, r["_at"], r["_codes"]) for r in out.collect()} == {(i, i, i) for i in range(50)}


def test_many_license_mentions_take_no_square():
    d = [licenses.Detection(10 * i, 10 * i + 9, i % 5) for i in range(100_000)]
    start = time.process_time()
    assert len(licenses.suppress(d)) == 100_000 and time.process_time() - start < 5
    nested = [licenses.Detection(0, 100, 3), licenses.Detection(10, 20, 4), licenses.Detection(10, 20, 2), licenses.Detection(90, 110, 9)]
    assert licenses.suppress(nested) == [nested[0], nested[2], nested[3]]


def test_names_of_any_length_and_with_particles(spark):
    texts = ["Dr Juan Carlos Garcia Lopez came", "Herr Ludwig van Beethoven schrieb. Beethoven war da", "Mrs Ana de la Cruz said", "Frau von der Leyen"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = [r.text for r in surrogates.replace_entities(df, "k").orderBy("doc_id").collect()]
    for real in ("Juan", "Carlos", "Garcia", "Lopez", "Ludwig", "Beethoven", "Ana", "Cruz", "Leyen"):
        assert not any(real in t for t in out), (real, out)
    assert " van " in out[1] and " de la " in out[2] and "von der" in out[3] and out[0].endswith(" came") and len(out[0].split()) == 6


def test_a_format_with_too_few_values_is_an_error(spark):
    full = spark.createDataFrame([("ssn", f"{i}") for i in range(10)], "kind string, canon string")
    with pytest.raises(RuntimeError, match="of kind ssn"):
        surrogates.assign(full, "k")
