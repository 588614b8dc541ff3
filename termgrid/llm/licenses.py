"""License scan: ordered signature rules over whole texts.

Rules are regular expressions: a table of licenses (names, identifiers,
keywords) written by hand and crossed with signature forms (identifier tag,
grant, version, title), and abbreviations, clause names and short grants written
one by one.  A multi-pattern keyword automaton tells which rules can match
a text at all; only those run.  Detections are intervals with a priority (the
rule's place in the order); one that lies inside an interval of a rule with the
same or a higher priority is suppressed, so "Apache License, Version 2.0" hides
the bare "Apache License" in it, and what is left names the labels.

Beside the rules stand base phrases: word sequences, counted at every place of
the text, which always keep their labels.  Words are runs of digits, a-z and
characters beyond ASCII after A-Z are lower-cased.

Defined results: a null text is empty: no words, no places, empty labels, score
0; repeated rows are scanned alike; an empty table gives an empty table; input
columns that clash with the outputs (in any case) are replaced.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from termgrid.llm.common import ALNUM, LOWER, blocks, find_words, without

# The phrases whose places are counted, and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# License label, identifier stem, name as a pattern, keywords of which any mention of the name holds one
# (separated by blanks; none holds white space, as a text may break its lines anywhere).
LICENSES = (
    ("agpl", "agpl", r"affero\s+general\s+public\s+licen[cs]e", "affero"),
    ("lgpl", "lgpl", r"(?:lesser|library)\s+general\s+public\s+licen[cs]e", "general"),
    ("gpl", "gpl", r"general\s+public\s+licen[cs]e", "general"),
    ("apache", "apache", r"apache\s+(?:software\s+)?licen[cs]e", "apache"),
    ("mpl", "mpl", r"mozilla\s+public\s+licen[cs]e", "mozilla"),
    ("epl", "epl", r"eclipse\s+public\s+licen[cs]e", "eclipse"),
    ("cpl", "cpl", r"common\s+public\s+licen[cs]e", "common"),
    ("cddl", "cddl", r"common\s+development\s+and\s+distribution\s+licen[cs]e", "development"),
    ("eupl", "eupl", r"european\s+union\s+public\s+licen[cs]e", "european"),
    ("mit", "mit", r"(?:the\s+)?\bmit\s+licen[cs]e", "mit"),
    ("bsd", "bsd", r"\bbsd[\s-]+licen[cs]e", "bsd"),
    ("isc", "isc", r"\bisc\s+licen[cs]e", "isc"),
    ("zlib", "zlib", r"\bzlib\s+licen[cs]e", "zlib"),
    ("boost", "bsl", r"boost\s+software\s+licen[cs]e", "boost"),
    ("artistic", "artistic", r"artistic\s+licen[cs]e", "artistic"),
    ("python", "python", r"python\s+(?:software\s+foundation\s+)?licen[cs]e", "python"),
    ("php", "php", r"\bphp\s+licen[cs]e", "php"),
    ("ruby", "ruby", r"\bruby\s+licen[cs]e", "ruby"),
    ("unlicense", "unlicense", r"\bthe\s+unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+licen[cs]e", "want"),
    ("ofl", "ofl", r"\bopen\s+font\s+licen[cs]e", "font"),
    ("odbl", "odbl", r"open\s+(?:database|data\s+commons)\s+(?:open\s+database\s+)?licen[cs]e", "open"),
    ("gfdl", "gfdl", r"\bfree\s+documentation\s+licen[cs]e", "documentation"),
    ("sspl", "sspl", r"server\s+side\s+public\s+licen[cs]e", "server"),
    ("busl", "busl", r"business\s+source\s+licen[cs]e", "business"),
    ("elastic", "elastic", r"elastic\s+licen[cs]e", "elastic"),
    ("osl", "osl", r"open\s+software\s+licen[cs]e", "software"),
    ("afl", "afl", r"academic\s+free\s+licen[cs]e", "academic"),
    ("ms-pl", "ms-pl", r"microsoft\s+public\s+licen[cs]e", "microsoft"),
    ("ms-rl", "ms-rl", r"microsoft\s+reciprocal\s+licen[cs]e", "reciprocal"),
    ("cecill", "cecill", r"\bcecill\s+licen[cs]e", "cecill"),
    ("lppl", "lppl", r"latex\s+project\s+public\s+licen[cs]e", "latex"),
    ("qpl", "qpl", r"q\s+public\s+licen[cs]e", "public"),
    ("sleepycat", "sleepycat", r"sleepycat\s+licen[cs]e", "sleepycat"),
    ("openssl", "openssl", r"openssl\s+licen[cs]e", "openssl"),
    ("vim", "vim", r"\bvim\s+licen[cs]e", "vim"),
    ("postgresql", "postgresql", r"postgresql\s+licen[cs]e", "postgresql"),
    ("upl", "upl", r"universal\s+permissive\s+licen[cs]e", "permissive"),
    ("bsl-coffee", "beerware", r"\bbeer-?ware\s+licen[cs]e", "beer"),
    ("cc-by-nc-nd", "cc-by-nc-nd", r"\bcc[\s-]by[\s-]nc[\s-]nd\b", "cc"),
    ("cc-by-nc-sa", "cc-by-nc-sa", r"\bcc[\s-]by[\s-]nc[\s-]sa\b", "cc"),
    ("cc-by-nc", "cc-by-nc", r"\bcc[\s-]by[\s-]nc\b", "cc"),
    ("cc-by-nd", "cc-by-nd", r"\bcc[\s-]by[\s-]nd\b", "cc"),
    ("cc-by-sa", "cc-by-sa", r"\bcc[\s-]by[\s-]sa\b", "cc"),
    ("cc-by", "cc-by", r"\bcc[\s-]by\b", "cc"),
    ("cc0", "cc0", r"\bcc0\b|creative\s+commons\s+zero", "cc0 zero"),
    ("creative-commons", "cc", r"creative\s+commons", "creative"),
    ("public-domain", "public-domain", r"\bpublic\s+domain\b", "domain"),
)
VERSION = r"(?:\s*[,(]?\s*(?:version|v\.?)?\s*\d+(?:\.\d+)*(?:\s+or\s+(?:any\s+)?later(?:\s+version)?)?\)?)"
# Signature forms, most telling first: (form, prefix, suffix, confidence); {id} and {name} are filled in.
FORMS = (
    ("tag", r"spdx-license-identifier:\s*{id}(?:-[\w.+-]+)?\b", 1.0),
    ("grant", r"(?:licen[cs]ed|released|distributed|available|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:gnu\s+)?(?:{name}){version}?", 0.95),
    ("redistribution", r"redistribut\w+[^.]{{0,80}}?under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:gnu\s+)?(?:{name}){version}?", 0.9),
    ("copy", r"copy\s+of\s+the\s+(?:gnu\s+)?(?:{name})", 0.85),
    ("version", r"(?:gnu\s+)?(?:{name}){version}", 0.8),
    ("link", r"(?:opensource|choosealicense|gnu|creativecommons|spdx)\.(?:org|com)/licen[cs]es?/{id}[\w./-]*", 0.8),
    ("name", r"(?:gnu\s+)?(?:{name})", 0.6),
)
# Signatures that belong to no license of the table: (label, pattern, keywords, confidence).
OTHERS = (
    ("reserved", r"all\s+rights\s+reserved", "rights", 0.9),
    ("copyright", r"(?:©|\(c\)|\bcopyright)\s+(?:©|\(c\)\s+)?(?:19|20)\d\d", "19 20", 0.5),
    ("copyright", r"(?:©|\(c\)|\bcopyright)\s+(?:©|\(c\)\s+)?(?:by\s+)?[a-z]", "© (c) copyright", 0.4),
    ("mit", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge", "hereby", 0.95),
    ("bsd", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", "redistribution", 0.95),
    ("isc", r"permission\s+to\s+use,\s+copy,\s+modify,?\s+and(?:/or)?\s+distribute\s+this\s+software", "permission", 0.95),
    ("no-warranty", r"provided\s+[\"“]?as[\s-]is[\"”]?,?\s+without\s+warrant", "as", 0.5),
    ("proprietary", r"proprietary\s+and\s+confidential", "proprietary", 0.9),
)
_NUMBER = r"(?:[\s-]*(?:version\s*|v\.?\s*)?\d+(?:\.\d+)*(?:\+|-or-later|-only)?)"
_UNDER = r"(?:licen[cs]ed|released|distributed|available|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?"
_CLAUSES = r"(?:[0234]|zero|two|three|four)[\s-]+clause"
# Abbreviations, clause names and short grants, written by hand: (label, pattern, keywords, confidence).
SHORT = (
    ("agpl", r"(?<![a-z0-9])(?:gnu\s+)?agpl" + _NUMBER + r"?(?![a-z])", "agpl", 0.7),
    ("lgpl", r"(?<![a-z0-9])(?:gnu\s+)?lgpl" + _NUMBER + r"?(?![a-z])", "lgpl", 0.7),
    ("gpl", r"(?<![a-z0-9])(?:gnu\s+)?gpl" + _NUMBER + r"?(?![a-z])", "gpl", 0.7),
    ("gfdl", r"\bgfdl\b|\bfdl[\s-]*v?1\.\d\b", "fdl", 0.7),
    ("bsd", _UNDER + r"bsd\b", "bsd", 0.9),
    ("bsd", r"\bbsd[\s-]+" + _CLAUSES + r"(?:\s+licen[cs]e)?\b", "bsd", 0.85),
    ("bsd", r"\b" + _CLAUSES + r"\s+bsd(?:\s+licen[cs]e)?\b", "bsd", 0.85),
    ("bsd", r"\bbsd[\s-]+(?:style|like|type)\s+licen[cs]e|\bbsd[\s-]+licen[cs]ed\b", "bsd", 0.7),
    ("mit", _UNDER + r"mit\b", "mit", 0.9),
    ("mit", r"\bmit[\s-]+licen[cs]ed\b|\bmit[\s-]style\s+licen[cs]e|\bmit/x11\b|\blicen[cs]e:\s*mit\b", "mit", 0.8),
    ("mit", r"\bexpat\s+licen[cs]e|\bx11\s+licen[cs]e", "expat x11", 0.7),
    ("isc", _UNDER + r"isc\b", "isc", 0.9),
    ("isc", r"\bisc[\s-]+licen[cs]ed\b|\blicen[cs]e:\s*isc\b", "isc", 0.8),
    ("apache", r"\bapache[\s-]+(?:licen[cs]e[\s-]+)?(?:version\s*|v\.?\s*)?(?:1\.[01]|2(?:\.0)?)(?!\.?\d)", "apache", 0.7),
    ("apache", r"\b(?:asl|alv?)[\s-]?2(?:\.0)?\b|" + _UNDER + r"apache\b", "asl al apache", 0.7),
    ("mpl", r"\bmpl[\s-]*v?\.?\s*[12](?:\.\d)?\b|" + _UNDER + r"mpl\b", "mpl", 0.7),
    ("epl", r"\bepl[\s-]*v?\.?\s*[12](?:\.\d)?\b|" + _UNDER + r"epl\b", "epl", 0.7),
    ("cpl", r"\bcpl[\s-]*v?\.?\s*[01]\.\d\b", "cpl", 0.7),
    ("cddl", r"\bcddl\b(?:[\s-]*v?\.?\s*1\.\d\b)?", "cddl", 0.7),
    ("eupl", r"\beupl\b(?:[\s-]*v?\.?\s*1\.\d\b)?", "eupl", 0.7),
    ("zlib", r"\bzlib/libpng\b|" + _UNDER + r"zlib\b", "zlib", 0.7),
    ("boost", r"\bboost\s+licen[cs]e|\bbsl-1\.0\b", "boost bsl", 0.7),
    ("python", r"\bpsf(?:l|[\s-]+licen[cs]e)\b", "psf", 0.7),
    ("unlicense", r"\bunlicense\b", "unlicense", 0.6),
    ("wtfpl", r"\bwtfpl\b", "wtfpl", 0.8),
    ("ofl", r"\b(?:sil\s+)?ofl[\s-]*v?1\.[01]\b", "ofl", 0.7),
    ("odbl", r"\bodbl\b", "odbl", 0.7),
    ("sspl", r"\bsspl\b", "sspl", 0.7),
    ("upl", r"\bupl-1\.0\b", "upl", 0.7),
    ("artistic", r"\bartistic[\s-]+(?:1|2)\.0\b", "artistic", 0.7),
    ("cecill", r"\bcecill(?:-[bc])?\b", "cecill", 0.6),
    ("creative-commons", r"\bcreativecommons\.org\b", "creativecommons", 0.6),
)


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    confidence: float


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, by priority: form by form in the order above, within a form license by license, then the short ones."""
    made = [Rule(label, re.compile(pattern), tuple(keys.split()), c) for label, pattern, keys, c in OTHERS if c >= 0.9]
    for form, pattern, confidence in FORMS:
        for label, stem, name, keywords in LICENSES:
            made.append(Rule(
                label, re.compile(pattern.format(id=re.escape(stem), name=name, version=VERSION)),
                tuple({"tag": "spdx-license", "link": "licen"}.get(form, keywords).split()), confidence,
            ))
    made += [Rule(label, re.compile(pattern), tuple(keys.split()), c) for label, pattern, keys, c in (*SHORT, *(o for o in OTHERS if o[3] < 0.9))]
    return tuple(made)


@functools.cache
def keyword_gate():
    """An automaton over the keywords; each leads to the rules it opens."""
    import ahocorasick

    opens: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for keyword in rule.keywords:
            opens.setdefault(keyword, []).append(i)
    automaton = ahocorasick.Automaton()
    for keyword, numbers in opens.items():
        automaton.add_word(keyword, tuple(numbers))
    automaton.make_automaton()
    return automaton


# What any rule's match holds; texts without all of these need no automaton run.
TELLING = re.compile(
    r"licen[cs]|cc[\s-]by|cc0|creative\s+commons|public\s+domain|rights\s+reserved|copyright|©|\(c\)|hereby"
    r"|redistribution|permission\s+to\s+use|as[\s-]is|proprietary|spdx"
    r"|gpl|fdl|bsd|(?<![a-z0-9])(?:mit|isc|apache|asl|alv?)(?![a-z])|[me]pl|e?upl|cpl|cddl|zlib|bsl-|psf|wtfpl|ofl|odbl|sspl|artistic|cecill"
    r"|redistribut|creativecommons|copy\s+of\s+the"
)


class Detection(NamedTuple):
    start: int
    end: int
    priority: int  # 0 is the highest


def suppress(found: list[Detection]) -> list[Detection]:
    """Drop every detection inside another one of the same or a higher priority; of equal ones the first rule stays."""
    kept: list[Detection] = []
    around: list[Detection] = []  # kept ones that reach to the current place; all start before it
    for d in sorted(found, key=lambda d: (d.start, -d.end, d.priority)):
        around = [k for k in around if k.end > d.start]
        if not any(d.end <= k.end and k.priority <= d.priority for k in around):
            kept.append(d)
            around.append(d)
    return kept


def scan(text: str) -> list[Detection]:
    """Detections in a text, A-Z lower-cased, after suppression."""
    if not TELLING.search(text):
        return []
    opened = {n for _, numbers in keyword_gate().iter(text) for n in numbers}
    table = rules()
    return suppress([
        Detection(m.start(), m.end(), n) for n in sorted(opened) for m in table[n].pattern.finditer(text)
    ])


def base_places(data: bytes) -> list[tuple[int, str]]:
    """(byte position, label) of every base phrase in lower-cased UTF-8."""
    places = []
    for words, label, pattern in _base_patterns():
        if all(w in data for w in words):
            places += [(m.start(1), label) for m in pattern.finditer(data)]
    return places


@functools.cache
def _base_patterns():
    inside, outside = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]"
    made = []
    for phrase, label in BASE_PHRASES:
        words = phrase.encode().split()
        body = (outside + b"+").join(words)
        made.append((words, label, re.compile(b"(?<!" + inside + b")(?=(" + body + b")(?!" + inside + b"))")))
    return tuple(made)


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label:string,start:int,end:int,confidence:double>>"
)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add word and base counts, labels, a score and the detections (character intervals of the lower-cased text)."""
    outputs = T._parse_datatype_string(SCHEMA)
    base = without(docs, *(f.name for f in outputs.fields if f.name != text))
    arrow = pa.schema([
        *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()),
        ("labels", pa.string()), ("score", pa.float64()),
        ("detections", pa.list_(pa.struct([
            ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()),
        ]))),
    ])

    def run(batches):
        table = rules()
        for batch in batches:
            for first, end, data, offsets in blocks(batch, text):
                lowered = LOWER[data]
                words = find_words(lowered, offsets, ALNUM)
                raw = lowered.tobytes()
                rows = []
                for i in range(end - first):
                    own = raw[offsets[i] : offsets[i + 1]]
                    places = base_places(own)
                    at = np.searchsorted(words.starts, np.array([p for p, _ in places], dtype=np.int64) + offsets[i])
                    at = at - words.first[i]
                    found = scan(own.decode())
                    base_labels = {label for _, label in places}
                    score = 1.0 - float(np.prod([1.0 - table[d.priority].confidence for d in found] + [0.05] * bool(places)))
                    rows.append({
                        "n_words": int(words.first[i + 1] - words.first[i]), "n_base": len(places),
                        "first_word": int(at.min()) if places else None, "last_word": int(at.max()) if places else None,
                        "base_labels": ",".join(sorted(base_labels)),
                        "labels": ",".join(sorted(base_labels | {table[d.priority].label for d in found})),
                        "score": score,
                        "detections": [{
                            "label": table[d.priority].label, "start": d.start, "end": d.end,
                            "confidence": table[d.priority].confidence,
                        } for d in found],
                    })
                added = pa.Table.from_pylist(rows, schema=arrow).combine_chunks().to_batches()[0]
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *added.columns], [*part.schema.names, *arrow.names])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *outputs.fields]))
