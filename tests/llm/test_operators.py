"""Each operator against a brute-force version or an exact round trip, on small tables with awkward rows."""

import base64
import hashlib
import itertools
import re
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from termgrid.llm import ann, bpe, jaccard, language, licenses, mips, mixing, queries, substrings, surrogates, urls

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(60))
EDITED = BASE.replace("w7 ", "x7 ")
TEXTS = [
    (1, BASE), (2, BASE.upper()), (3, EDITED), (4, EDITED + " more words at the end"), (5, None), (6, ""), (7, " \n\t "), (8, "one"),
    (9, "One"), (10, "a b"), (11, "Für \u00a0x \x00 日本語 e\u0301 " * 3), (None, BASE), (12, BASE), (12, BASE),
    (13, " ".join(f"v{i % 40}" for i in range(3000))), (14, "start " + " ".join(f"w{i}" for i in range(10, 50)) + " end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "kept") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, N_Words string, extra string").repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    words = WORDS.findall(lower(text))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_components(texts, n, percent):
    sets = [shingles(t, n) for _, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(texts, sets))), key=str)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, n, percent):
    got = jaccard.jaccard_components(docs, n=n, percent=percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_components(TEXTS, n, percent)


def test_jaccard_clouds_and_all_links(spark):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(120):
        words = [f"b{i}" for i in range(150)]
        for at in rng.integers(0, 150, rng.integers(0, 6)):
            words[at] = f"e{k}.{at}"
        texts.append((k, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = jaccard.document_sets(docs)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(sets).collect())
    assert got == sorted(brute_components(texts, 3, 90))
    names = {}
    for r in sets.collect():
        names.setdefault(r["class"], shingles(dict(texts)[r.doc_id], 3))
    want = {(a, b) for a, b in itertools.combinations(sorted(names), 2) if 100 * len(names[a] & names[b]) >= 90 * len(names[a] | names[b])}
    assert {(r.a, r.b) for r in jaccard.links(sets).collect()} == want


def brute_removed(texts, size):
    words = [(t or "").encode().split() for _, t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] = seen.get(tuple(w[i : i + size]), 0) + 1
    out = []
    for (i, _), w in zip(texts, words):
        covered = [any(seen[tuple(w[s : s + size])] > 1 for s in range(max(0, p - size + 1), min(p, len(w) - size) + 1)) for p in range(len(w))]
        out.append((i, len(w), sum(covered), b" ".join(x for x, c in zip(w, covered) if not c).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size, group", [(35, substrings.GROUP), (35, 0), (5, 2)])
def test_substrings(docs, size, group):
    got = substrings.dedup_substrings(docs, size=size, group=group)
    assert "extra" in got.columns
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == brute_removed(TEXTS, size)


def test_licenses(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0"), (2, "ALL RIGHTS-reserved. cc by! all rights reserved"), (3, None), (4, ""),
        (5, "xcc by and général public license"), (6, "GNU General Public License v3"), (7, "SPDX-License-Identifier: MIT"), (8, "clean words"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache" and len(got[1].detections) == 1  # the longer detection hides those inside
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert (got[3].n_words, got[3].n_base, got[3].labels, got[3].score) == (0, 0, "", 0.0) == (got[4].n_words, got[4].n_base, got[4].labels, got[4].score)
    assert got[5].n_base == 0 and got[5].n_words == 6
    assert got[6].base_labels == "gpl" and got[7].labels == "mit" and got[8].score == 0
    assert len(licenses.rules()) > 200


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(300)]
    rows += [(300 + i, rows[3][1], 0) for i in range(40)]  # one vector often
    rows += [(400, None, 0), (401, [], 0), (402, [float("nan")] * 8, 0), (403, [None] * 8, 0), (404, [0.0] * 8, 0), (None, [1.0] * 8, 0)]
    rows.append(rows[0])
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def brute_nearest(rows, every, k, whole, zero):
    found = {}
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = np.array(v, dtype=np.float32).astype(float)
        if zero or x.any():
            found[i] = np.floor(256 * x) if whole else x
    out = []
    for q in sorted(found):
        if q % every == 0:
            best = sorted(((-float(found[q] @ found[c]), c) for c in found if c != q))[:k]
            out += [(q, n + 1, c, round(-s, 9)) for n, (s, c) in enumerate(best)]
    return out


def test_exact_top_products(spark):
    rows, df = vectors(spark)
    got = mips.search(df, F.col("vec_id") % 50 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_nearest(rows, 50, 5, True, True)
    assert mips.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_exact_top_products_over_many_blocks_and_lengths(spark, monkeypatch):
    """Blocks of four, lengths over forty octaves, crowded bands cut by salts: nothing is lost, shorter vectors count as padded."""
    monkeypatch.setattr(mips, "VECTOR_BLOCK", 4)
    monkeypatch.setattr(mips, "QUERY_BLOCK", 3)
    monkeypatch.setattr(mips, "CROWD", 2)
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=6) * (2.0 ** (i % 40 - 20) if i % 2 else 1.0)).tolist()[: 6 - i % 2], 7) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")  # a column named as an output
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mips.search(df, F.col("vec_id") % 50 == 0).collect())
    whole = {i: [int(np.floor(256 * x)) for x in v] + [0] * (6 - len(v)) for i, v, _ in rows}
    expected = []
    for q in range(0, 400, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == expected
    long = spark.createDataFrame([(0, [1e12]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        mips.search(long, F.col("vec_id") % 50 == 0)


def test_forest_search(spark):
    rows, df = vectors(spark)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df, F.col("vec_id") % 20 == 0, leaves=8).collect())
    want = brute_nearest(rows, 20, 20, False, False)
    pairs = {(q, v) for q, _, v, _ in want}
    assert len(got) == len(want) and len(pairs & {(q, v) for q, _, v, _ in got}) >= 0.9 * len(pairs)
    exact = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df, F.col("vec_id") % 20 == 0, leaves=8, share=99.0).collect())
    assert exact == want
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bpe_matches_the_reference_tokenizer_and_decodes(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = public_tokenizers.path(queries.VOCABULARY)
    awkward = ["a  b", " lead", "trail ", "x\n\n y", "<|endoftext|> it's 12th", "🙂 日本", "\u3000a \u2028 b", "a\r\n b\n", "\x1c \x85 "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(awkward)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = bpe.decode(bpe.encode(rows, vocabulary, offsets=True), vocabulary).collect()
    for r in got:
        text = r.text or ""
        assert r.ids == plain.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert [text[a:b] for a, b in r.offsets][:1] == ([text[: r.offsets[0][1]]] if r.ids else [])
    digests = {(r.doc_id, r.text): r for r in bpe.round_trip(rows, vocabulary).collect()}
    for r in got:
        assert digests[r.doc_id, r.text].ids_sha256 == hashlib.sha256(np.array(r.ids, dtype="<u4").tobytes()).hexdigest()


def test_urls(spark):
    rows = [
        (1, "http://Example.NET/en/x?q#f"), (2, "https://sub.example.net/de"), (3, "http://example.com/de/"), (4, "http://a.org/fr/1"),
        (5, None), (6, "no scheme"), (7, "http://net"), (8, "http://notexample.com/de/"), (9, "x://net/?a://org/fr/"),
    ]
    df = spark.createDataFrame([(i, u, "old") for i, u in rows], "page_id long, url string, HOST string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, queries.ALLOW_URLS, queries.BLOCK_URLS).collect()}
    assert got == {
        1: ("example.net", "/en/x", "example.net/en/", "allow"), 2: ("sub.example.net", "/de", "net/", "block"),
        3: ("example.com", "/de/", "example.com/de/", "block"), 4: ("a.org", "/fr/1", "org/fr/", "allow"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("net", "", None, "allow"), 8: ("notexample.com", "/de/", None, "allow"), 9: ("net", "/", "net/", "block"),
    }
    with pytest.raises(ValueError):
        urls.filter_urls(df, ["a"], ["b"], max_rules=1)


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 40)), f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(1500)]
    rows += [(5000, None, "s1"), (None, "a b c", "tiny"), rows[20], rows[20]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.with_mix(df).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    shares = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in shares.values()) == pytest.approx(total)
    for source, (size, target) in shares.items():
        assert target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 3 * 40
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    again = sorted(map(str, mixing.with_mix(df.repartition(5)).select(*got[0].__fields__).collect()))
    assert again == sorted(map(str, got))
    assert mixing.with_mix(df.limit(0)).count() == 0
    assert mixing.mixed(df).count() == sum(r.copies for r in got)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    awkward = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "12 34 !!", "en"), (None, "the of and to in is was", None)], docs.schema)
    both = docs.unionByName(awkward)
    found = language.predict(both.withColumn("held", language.held_out()), language.fit(language.learnable(both))).collect()
    held = [r for r in found if r.held and r.text]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in found}
    assert by_id[10**6].lang_pred == by_id[10**6 + 1].lang_pred == "und" and by_id[10**6].score == 0
    assert all(0 <= r.score <= 1 for r in found)
    nothing = language.fit(both.limit(0))
    assert {r.lang_pred for r in language.predict(both, nothing).collect()} == {"und"}


def luhn(digits):
    values = [int(c) for c in digits][::-1]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def test_surrogates(spark):
    rows = [
        (1, "Mail a.b1@mail.example.com or A.B1@MAIL.EXAMPLE.COM now"), (2, "card 4111 1111 1111 1111 and 4111-1111-1111-1111."),
        (3, "call +1 (337) 555-7349 from 10.20.30.40"), (4, 'token = "0123456789abcdef0123"'), (5, "Mrs Anna Gil met Ms. Gil and Herr Gil"),
        (6, None), (7, ""), (8, "nothing here 12 of 2020"), (9, "а г-н Иван Петров"), (10, "a.b1@mail.example.com"), (10, "a.b1@mail.example.com"),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, N_ENTITIES int")
    got = {r.doc_id: r for r in surrogates.replace_entities(df, "k").collect()}
    mail = got[10].text
    assert re.fullmatch(r"[a-z]\.[a-z]\d@m[0-9a-f]{6}\.example\.com", mail)
    assert got[1].text == f"Mail {mail} or {mail.upper()} now" and got[1].n_entities == 2
    spaced, dashed = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{4}-\d{4}-\d{4}-\d{4})\.", got[2].text).groups()
    assert spaced.replace(" ", "") == dashed.replace("-", "") != "4" + "1" * 15 and luhn(dashed.replace("-", "")) and dashed[0] == "4"
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} from 10\.\d+\.\d+\.\d+", got[3].text) and "337" not in got[3].text
    assert re.fullmatch(r'token = "[0-9a-f]{20}"', got[4].text) and "0123456789" not in got[4].text
    names = re.fullmatch(r"Mrs (\w+) (\w+) met Ms\. (\w+) and Herr (\w+)", got[5].text).groups()
    assert names[1] == names[2] == names[3] != "Gil" and names[0] in surrogates.GIVEN["latin", "f"]
    assert got[6].text is None and got[7].text == "" and got[8].text == rows[7][1] and got[8].n_entities == 0
    assert re.fullmatch(r"а г-н ([А-Яё]\w+) (\w+)", got[9].text, re.I).group(1) in surrogates.GIVEN["cyrillic", "m"]


def test_surrogates_stay_distinct(spark):
    entities = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(30)] + [("given-f", f"Name{i}") for i in range(30)], "kind string, canon string")
    got = surrogates.assign(entities, "k").collect()
    assert len({(r.kind, r.surrogate.lower()) for r in got}) == len(got) == 60
    real = {(r.kind, r.canon.lower()) for r in got}
    assert not any((r.kind, r.surrogate.lower()) in real for r in got)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard.jaccard_components(none).count() == 0
    assert substrings.dedup_substrings(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert surrogates.replace_entities(none, "k").count() == 0
    assert bpe.round_trip(none, public_tokenizers.path(queries.VOCABULARY)).count() == 0


def test_surrogates_leave_look_alikes_alone(spark):
    texts = [
        "years 2010 2011 2012 2013 and on", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "at 1700000000000 ms", "id 9807915762804490 and 4111111111111112",
        "1 0 2 0 3 0 4 0 5 0 6 0 7 0 8 0", "4111 1111 1111 1111 4000 5000", "411 111 111 111 111 1", "x4111111111111111y", "250 300 45000", "2221-2010-2011-2012",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.text: r.n_entities for r in surrogates.replace_entities(df, "k").collect()} == dict.fromkeys(texts, 0)
    cards = ["4111111111111111", "4111-1111-1111-1111", "5555 5555 5555 4444", "3782 822463 10005", "378282246310005", "6011111111111117"]
    vouched = ["card number: 1234 5678 9012 3456", "Visa 4111 1111 1111 1112", "api_key=4111111111111112"]
    texts = [f"a {c}, b" for c in cards] + vouched
    got = {r.doc_id: r for r in surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    for i, text in enumerate(texts):
        assert got[i].n_entities == 1 and got[i].text != text and re.sub(r"\d", "0", got[i].text) == re.sub(r"\d", "0", text)
        assert i >= len(cards) or luhn(re.sub(r"\D", "", got[i].text))


def test_surrogates_find_all_forms(spark):
    rows = [
        (0, "ghp_ABCDEFGHIJKLMNOPQRSTUVWX", "ABCDEFGH"), (1, "API_KEY=abcdefghijk", "abcdefgh"), (2, "Password: correcthorse", "correct"), (3, "SECRET=battery/staple", "battery"),
        (4, "1-555-123-4567", "4567"), (5, "tell 555 123 4567 now", "123 4567"), (6, "030 1234567", "1234567"), (7, "06 12 34 56 78", "34 56 78"),
        (8, "tel. 612345678", "612345678"), (9, "Client_Secret = \"abcdefghijkl\"", "abcdefgh"),
    ]
    got = {r.doc_id: r for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string, real string"), "k").collect()}
    for r in got.values():
        assert r.n_entities == 1 and r.real not in r.text and len(r.text) == len(rows[r.doc_id][1]), r
    for kind, pattern in surrogates.PATTERNS:
        assert kind in ("email", "secret", "name") or r"\d" in pattern  # what the hint's digits stand for


def test_surrogates_of_names_without_a_title(spark):
    rows = [
        (1, "Ms Ana Gil wrote. Ana Gil said, as Gil does: Gilbert met Ana's aunt. Gil-Robles stays."), (2, "Ana Gil is not known here"),
        (3, "Herr\nOtto  Gil und Frau Eva Berg. Eva Berg rief Otto, dann Berg."), (4, "a г-н Иван Петров. Петров"), (5, "Ms Gil's book and Gil's pen"),
    ]
    got = {r.doc_id: r for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    given, family = re.fullmatch(r"Ms (\w+) (\w+) wrote\. .*", got[1].text).groups()
    assert got[1].text == f"Ms {given} {family} wrote. {given} {family} said, as {family} does: Gilbert met {given}'s aunt. Gil-Robles stays."
    assert family != "Gil" and given != "Ana" and got[1].n_entities == 4
    assert got[2].text == rows[1][1] and got[2].n_entities == 0
    otto, gil, eva, berg = re.match(r"Herr\n(\w+)  (\w+) und Frau (\w+) (\w+)\.", got[3].text).groups()
    assert got[3].text == f"Herr\n{otto}  {gil} und Frau {eva} {berg}. {eva} {berg} rief {otto}, dann {berg}." and gil == family != berg
    assert re.fullmatch(r"a г-н \w+ (\w+)\. \1", got[4].text) and "Петров" not in got[4].text
    assert got[5].text == f"Ms {family}'s book and {family}'s pen"


def sample(parsed, rng):
    """A string that a parsed pattern matches, white space as line feeds; places aside."""
    out = ""
    for op, value in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "NOT_LITERAL":
            out += "x"
        elif op == "IN":
            items = [i for i in value if str(i[0]) != "NEGATE"]
            kind, item = ("LITERAL", ord("x")) if len(items) < len(value) else items[rng.integers(len(items))]
            names = {"CATEGORY_SPACE": "\n", "CATEGORY_DIGIT": "1", "CATEGORY_WORD": "w"}
            out += names[str(item)] if str(kind) == "CATEGORY" else chr(item[0] if str(kind) == "RANGE" else item)
        elif op == "BRANCH":
            out += sample(value[1][rng.integers(len(value[1]))], rng)
        elif op == "SUBPATTERN":
            out += sample(value[-1], rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            out += "".join(sample(inner, rng) for _ in range(rng.integers(low, min(int(high), low + 2) + 1)))
        else:
            assert op in ("AT", "ASSERT", "ASSERT_NOT"), op
    return out


def test_license_keywords_open_every_match():
    rng = np.random.default_rng(3)
    for rule in licenses.rules():
        assert not any(c.isspace() for k in rule.keywords for c in k)
        matches = [m.group() for _ in range(40) for m in [rule.pattern.search(sample(re._parser.parse(rule.pattern.pattern), rng))] if m]
        assert matches, rule
        for match in matches:
            assert any(k in match for k in rule.keywords) and licenses.TELLING.search(match), (rule, match)
            assert licenses.scan(match), (rule, match)


@pytest.mark.parametrize("text, label", [
    ("MIT\nLicense", "mit"), ("Creative\nCommons", "creative-commons"), ("Public  Domain", "public-domain"), ("Creative Commons Zero", "cc0"),
    ("GPLv3", "gpl"), ("LGPL 2.1", "lgpl"), ("AGPL-3.0-or-later", "agpl"), ("BSD 3-Clause License", "bsd"), ("two-clause BSD license", "bsd"),
    ("released under the MIT", "mit"), ("Apache-2.0", "apache"), ("MPL 2.0", "mpl"), ("(c) 1998 x", "copyright"), ("© Someone", "copyright"),
])
def test_license_abbreviations_and_broken_lines(text, label):
    found = licenses.scan(lower(f"see {text}, and more"))
    assert {licenses.rules()[d.priority].label for d in found} == {label}


def test_bpe_table_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 100_000)
    c = bpe.Codec(public_tokenizers.path(queries.VOCABULARY))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k in range(40):
        texts = [f"{k} {i}  indented\n\n\tx{i * k} \n y\x1c z\u3000 {'long' * 30}{i}\r\n\r\n  " + "w " * 50 for i in range(50)]
        assert c.encode(texts) == [np.array(plain.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]
        assert all(len(cut) <= 64 for cut in c.known) and c.known_bytes <= 100_000
        assert sum(sys.getsizeof(a) + sys.getsizeof(b) for a, b in c.known.items()) <= c.known_bytes


def test_long_words_that_mirror_each_other_stay_apart(spark):
    # a Thue-Morse word and its complement: equal under every polynomial hash modulo a power of two
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    words = ["".join("ab"[b ^ flip] for b in bits[:n]) for n in (400, 1024, 4096) for flip in (0, 1)]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()) == [(i, i) for i in range(6)]


def test_word_hashes_tell_all_words_apart():
    from termgrid.llm import common

    texts = [" ".join(f"{'x' * k}{i}" for i in range(300)) for k in (0, 1, 5, 7, 8, 9, 15, 16, 500, 505, 513, 600)] + ["\x00 \x00\x00 a a\x00"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    words = common.find_words(data, offsets, common.BLANK_SEPARATED)
    named = [bytes(data[a:b]) for a, b in zip(words.starts, words.ends)]
    hashes = common.hash_words(data, words)
    assert len(set(hashes.tolist())) == len(set(named)) and len({(n, h) for n, h in zip(named, hashes.tolist())}) == len(set(named))
    none = common.find_words(np.zeros(0, np.uint8), np.array([0, 0]), common.BLANK_SEPARATED)
    assert len(common.hash_words(np.zeros(0, np.uint8), none)) == 0


def test_large_ids_beside_null_ones(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, BASE), (None, "a b c d"), (big + 2, BASE), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {(big, big), (big + 2, big), (None, None), (3, 3)}


def test_decoding_refuses_what_is_no_id(spark):
    vocabulary = public_tokenizers.path(queries.VOCABULARY)
    for bad in ([-1], [10**6], [5, None]):
        with pytest.raises(Exception, match="vocabulary|null among"):
            bpe.decode(spark.createDataFrame([(bad,)], "ids array<int>"), vocabulary).collect()
    df = spark.createDataFrame([([],), (None,), ([40],), (list(range(5000)),)], "ids array<int>").coalesce(1)
    assert [len(r.decoded) for r in bpe.decode(df, vocabulary).collect()][:3] == [0, 0, 1]


def test_working_names_are_free(spark):
    df = spark.createDataFrame([(1, BASE, 2, 3, 4, 5), (2, BASE, 2, 3, 4, 5)], "doc_id long, text string, _key long, _hits long, _rows long, _d long")
    for found in (substrings.dedup_substrings(df, size=5), bpe.round_trip(df, public_tokenizers.path(queries.VOCABULARY))):
        assert {(r["_key"], r["_hits"], r["_rows"], r["_d"]) for r in found.collect()} == {(2, 3, 4, 5)}
