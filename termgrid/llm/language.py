"""Language identification by hierarchical discrimination.

A text is its byte bigrams and trigrams (Latin letters lower-cased), hashed into
a fixed number of counts and scaled to length one.  A first layer of linear
support vector machines, one for each pair of language families, picks the
family; a second layer, one for each pair of languages of a family, picks the
language.  Each pair's machine is fitted by its own task on a bounded sample of
labelled rows: at most ``per_language`` rows of a language, chosen by a hash of
their text, so a rerun chooses the same rows.

Only text is looked at when predicting.  Defined results: a text that is null or
has no letter gets ``und`` with score 0; with no labelled row at all every text
gets ``und``; with a single learned language every text with letters gets it;
repeated rows are predicted alike; an empty table gives an empty table; input
columns that clash with the outputs (in any case) are replaced.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgrid.llm.common import LOWER, blocks, without

FEATURES = 2048
ROUNDS = 60
UNKNOWN = "und"

# Language codes by family; other codes form the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi fo",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "hellenic": "el",
    "turkic": "tr az kk uz tt",
    "semitic": "ar he mt am",
    "indo-iranian": "hi ur bn pa mr ne fa ku",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(language: str) -> str:
    return _FAMILY.get(language.lower().replace("_", "-").split("-")[0], "other")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scaled n-gram counts, a row for each text."""
    n = len(offsets) - 1
    data = LOWER[data]
    accented = np.zeros(len(data), dtype=bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    data = np.where(accented, data + 0x20, data).astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(offsets))
    counts = np.zeros(n * FEATURES, dtype=np.float64)
    for size in (2, 3):
        m = len(data) - size + 1
        if m <= 0:
            continue
        code = np.zeros(m, dtype=np.uint32)
        for i in range(size):
            code = code * np.uint32(0x01000193) + data[i : i + m] + np.uint32(1)
        code = ((code * np.uint32(0x9E3779B1)) >> np.uint32(21)).astype(np.int64)
        whole = row[:m] == row[size - 1 :]  # not across two texts
        counts += np.bincount((row[:m] + code)[whole], minlength=n * FEATURES)
    counts = np.log1p(counts.reshape(n, FEATURES))
    norm = np.linalg.norm(counts, axis=1, keepdims=True)
    return counts / np.where(norm > 0, norm, 1)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lowered = LOWER[data]
    seen = np.concatenate(([0], np.cumsum((lowered >= 0x61) & (lowered <= 0x7A))))
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return found


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    """Weights and intercept of a linear SVM (squared hinge loss, classes balanced), by accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    step = 1.0 / (2.0 * 2.0 + penalty)  # rows have squared length 2 with the intercept
    w = np.zeros(x.shape[1])
    ahead, momentum = w, 1.0
    for _ in range(ROUNDS * 5):
        short = np.maximum(0.0, 1.0 - y * (x @ ahead))
        new = ahead - step * (penalty * ahead - 2.0 * x.T @ (weight * y * short))
        following = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w


class Model(NamedTuple):
    languages: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]  # families first, then languages of a family; the first is the positive side
    weights: np.ndarray  # pairs x (FEATURES + 1)


def sample(labelled: DataFrame, text: str, label: str, per_language: int, key: str = "text") -> DataFrame:
    """At most per_language rows of each label, chosen by hash: first thinned out, then cut to the exact number."""
    from pyspark.sql import Window

    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where(
        "label is not null and text is not null and text rlike '\\\\p{L}'"
    )
    share = rows.groupBy("label").agg(F.lit(1.25 * per_language).__truediv__(F.count("*")).alias("share"))
    shares = {r["label"]: r["share"] for r in share.collect()}  # a row for each language
    if not shares:
        return rows
    at = F.xxhash64("text", F.lit(7))
    chosen = F.coalesce(*[
        F.when(F.col("label") == name, F.pmod(at, F.lit(1 << 20)) < F.lit(int(min(p, 1.0) * (1 << 20)) + 1))
        for name, p in shares.items()
    ])
    ranked = rows.where(chosen).withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(at, "text")))
    return ranked.where(F.col("n") <= per_language).drop("n")


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", per_language: int = 400) -> Model:
    """Fit every pair's machine, each in a task of its own, on the bounded sample."""
    chosen = sample(labelled, text, label, per_language)

    def extract(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch, "text"):
                x = features(data, offsets).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(first, end - first).cast(pa.string()), pa.array(list(x), pa.list_(pa.float32()))],
                    ["label", "x"],
                )

    rows = chosen.mapInArrow(extract, "label string, x array<float>").persist()
    languages = sorted(r["label"] for r in rows.select("label").distinct().collect())
    families = sorted({family(x) for x in languages})
    pairs = [*itertools.combinations(families, 2)] + [
        p for f in families for p in itertools.combinations([x for x in languages if family(x) == f], 2)
    ]
    if not pairs:
        rows.unpersist()
        return Model(tuple(languages), (), np.zeros((0, FEATURES + 1)))
    sides = [
        (n, x, sign) for n, (a, b) in enumerate(pairs) for x in languages
        for sign, side in ((1, a), (-1, b)) if side in ((family(x),) if n < len(families) * (len(families) - 1) // 2 else (x,))
    ]
    plan = rows.sparkSession.createDataFrame(sides, "pair int, label string, sign int")

    def fit_pair(group: pd.DataFrame) -> pd.DataFrame:
        w = fit_svm(np.stack(group["x"].to_numpy()).astype(np.float64), group["sign"].to_numpy().astype(np.float64))
        return pd.DataFrame({"pair": [group["pair"].iloc[0]], "w": [w]})

    fitted = rows.join(F.broadcast(plan), "label").groupBy("pair").applyInPandas(fit_pair, "pair int, w array<double>")
    weights = np.zeros((len(pairs), FEATURES + 1))
    for r in fitted.collect():  # a row for each pair
        weights[r["pair"]] = r["w"]
    rows.unpersist()
    return Model(tuple(languages), tuple(pairs), weights)


def decide(names: list[str], pairs: dict[tuple[str, str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-one votes, margins breaking ties: index into names, and the winner's share of certainty."""
    some = next(iter(pairs.values()))
    votes = np.zeros((len(some), len(names)))
    sure = np.ones((len(some), len(names)))
    for (a, b), margin in pairs.items():
        i, j = names.index(a), names.index(b)
        chance = 1.0 / (1.0 + np.exp(-4.0 * np.clip(margin, -20, 20)))
        votes[:, i] += (margin >= 0) + 1e-3 * np.tanh(margin)
        votes[:, j] += (margin < 0) - 1e-3 * np.tanh(margin)
        sure[:, i] = np.minimum(sure[:, i], chance)
        sure[:, j] = np.minimum(sure[:, j], 1 - chance)
    best = votes.argmax(axis=1)
    return best, sure[np.arange(len(best)), best]


def predict_block(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    margins = x @ model.weights[:, :-1].T + model.weights[:, -1]
    by_pair = {p: margins[:, n] for n, p in enumerate(model.pairs)}
    families = sorted({family(x) for x in model.languages})
    out = np.full(len(x), UNKNOWN, dtype=object)
    score = np.zeros(len(x))
    first = {p: m for p, m in by_pair.items() if p[0] in families and p[1] in families}
    chosen, sure = decide(families, first) if first else (np.zeros(len(x), int), np.ones(len(x)))
    for k, f in enumerate(families):
        here = chosen == k
        if not here.any():
            continue
        names = [x for x in model.languages if family(x) == f]
        inner = {p: m[here] for p, m in by_pair.items() if p[0] in names and p[1] in names}
        best, within = decide(names, inner) if inner else (np.zeros(here.sum(), int), np.ones(here.sum()))
        out[here] = np.array(names, dtype=object)[best]
        score[here] = sure[here] * within
    return out, score


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most (languages squared) x FEATURES numbers
    base = without(docs, "lang_pred", "score")

    def run(batches):
        m = shared.value
        for batch in batches:
            for first, end, data, offsets in blocks(batch, text):
                rows = batch.slice(first, end - first)
                names = np.full(end - first, UNKNOWN, dtype=object)
                score = np.zeros(end - first)
                letters = has_letter(data, offsets)
                if m.languages:
                    for a in range(0, end - first, 500):
                        b = min(a + 500, end - first)
                        x = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                        names[a:b], score[a:b] = predict_block(m, x)
                    names[~letters], score[~letters] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(list(names), pa.string()), pa.array(score)],
                    [*rows.schema.names, "lang_pred", "score"],
                )

    schema = [*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return base.mapInArrow(run, T.StructType(schema))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3; no id, no remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: an id, and not held out."""
    return docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id))
