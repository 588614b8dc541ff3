"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source gets a target number of words from its weight; a document of a
source then owes target / source size copies: the whole part is taken, and the
fraction is a copy probability.  Rounding the fractions one by one would let the
total drift, so they are rounded in pairs: of two fractional documents, words
move from one to the other, in a random direction whose odds keep each
document's expectation, until one of them holds a whole number of copies.  That
one is settled; the other meets the next document.  The total of a source never
changes, so it ends within one document of its target.

The pairing is a reduction tree: documents are dealt by hash into buckets of
at most about ``FAN`` rows, each bucket is folded in order (SQL ``aggregate``) and leaves
at most one fractional document, and these residuals are dealt and folded again
until one per source is left, which is drawn with its probability.  Choices come
from hashes of ids and a seed, so reruns agree.

Defined results: null and blank texts have size 0 and take nothing; a null source
is a source of its own, last in order; rows equal in id, source and text are one
unit and share their number of copies; a source of size 0 has target 0; an empty
table gives an empty table; input columns that clash with the outputs (in any
case) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgrid.llm.common import text_key, unused, without, word_count
from termgrid.sources.scratch import materialize

FAN = 256
CAP = 3.0  # no document is taken more often
WEIGHTS = (1.0, 2.0, 3.0)
NEAR = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a row for each source.

    Sources in code point order, null last, weigh the given numbers, repeating.
    Full sources stop at cap times their size and the excess is shared again by
    weight.  A source is full exactly when its size per weight is small: ordered
    by size / weight, source k is full iff what the sources before it leave,
    shared by the remaining weights, is at least cap times its size per weight,
    so one ordered pass finds the final shares.
    """
    # one row per source, so ordering them in one task is bounded by the number of sources
    named = Window.orderBy(F.col("source").isNull(), F.expr("encode(source, 'UTF-8')"))
    place = (F.row_number().over(named) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    upto = filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = cap * F.col("source_size")
    filled = weighed.withColumns({
        "left": F.sum("source_size").over(everything) - cap * (F.sum("source_size").over(upto) - F.col("source_size")),
        "open_weight": F.sum("weight").over(onward),
    })
    filled = filled.withColumn(
        "is_full", F.min(F.col("left") * F.col("weight") / F.col("open_weight") >= limit).over(upto)
    )
    rest = F.when(~F.col("is_full"), F.struct("left", "open_weight"))
    filled = filled.withColumn("rest", F.first(rest, ignorenulls=True).over(everything))
    target = F.when(F.col("is_full"), limit).otherwise(
        F.col("rest.left") * F.col("weight") / F.col("rest.open_weight")
    )
    return filled.select("source", "source_size", target.cast("double").alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


UNIT = "struct<id:string,source:string,mass:double,p:double>"


def _step(state: Column, unit: Column, seed: Column) -> Column:
    """Pair the carried unit with the next one; whoever becomes whole is settled."""
    carried = state["carried"]
    up = F.least((1.0 - carried["p"]) * carried["mass"], unit["p"] * unit["mass"])  # words the carried one can gain
    down = F.least(carried["p"] * carried["mass"], (1.0 - unit["p"]) * unit["mass"])
    gains = _uniform(carried["id"], unit["id"], seed) * (up + down) < down
    moved = F.when(gains, up).otherwise(-down)

    def at(value: Column) -> Column:
        return F.when(value < NEAR, 0.0).when(value > 1.0 - NEAR, 1.0).otherwise(value)

    def with_p(u: Column, p: Column) -> Column:
        return F.struct(u["id"].alias("id"), u["source"].alias("source"), u["mass"].alias("mass"), p.alias("p"))

    a = with_p(carried, at(carried["p"] + moved / carried["mass"]))
    b = with_p(unit, at(unit["p"] - moved / unit["mass"]))
    return F.struct(a.alias("a"), b.alias("b"))


def _fold(units: Column, seed: Column) -> Column:
    """settled: units with p 0 or 1; carried: the one that is left, maybe fractional."""
    empty = F.array().cast(f"array<{UNIT}>")

    def step(state: Column, unit: Column) -> Column:
        pair = _step(state, unit, seed)
        # bind the pair once: a lambda's argument is evaluated a single time
        return F.element_at(F.transform(F.array(pair), lambda q: F.struct(
            F.concat(
                state["settled"],
                F.array(F.when(q["a"]["p"].isin(0.0, 1.0), q["a"]).otherwise(q["b"])),
            ).alias("settled"),
            F.when(q["a"]["p"].isin(0.0, 1.0), q["b"]).otherwise(q["a"]).alias("carried"),
        )), 1)

    start = F.struct(empty.alias("settled"), F.element_at(units, 1).alias("carried"))
    return F.aggregate(F.slice(units, 2, F.size(units)), start, step)


def round_fractions(units: DataFrame, seed: int = 0) -> DataFrame:
    """Round the probabilities of (id, source, mass, p), 0 < p < 1, mass > 0: returns (id, copy) with copy 0 or 1."""
    level, done = 0, []
    while True:
        most = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        bucket = F.pmod(F.xxhash64("id", F.lit(seed + level)), F.lit(-(-most // FAN)))
        dealt = units.select("source", "id", "mass", "p", bucket.alias("bucket"))
        folded = dealt.groupBy("source", "bucket").agg(
            F.array_sort(F.collect_list(F.struct("id", "source", "mass", "p"))).alias("units")
        ).select(_fold(F.col("units"), F.lit(seed * 1_000_003 + level)).alias("state"))
        folded = materialize(folded.select("state.settled", "state.carried"), f"mix-{level}")
        done.append(folded.select(F.explode("settled").alias("u")).select("u.id", F.col("u.p").alias("p")))
        carried = folded.select("carried.*")
        done.append(carried.where(F.col("p").isin(0.0, 1.0)).select("id", "p"))
        units, level = carried.where(~F.col("p").isin(0.0, 1.0)), level + 1
    last = units.select("id", F.when(_uniform(F.col("id"), F.lit(seed), F.lit(-1)) < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    for part in done:
        last = last.unionByName(part)
    return last.select("id", F.col("p").cast("long").alias("copy"))


def with_mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, seed: int = 0,
) -> DataFrame:
    """Add size, source_size, target, copies and taken (copies times size) to every document."""
    base = without(docs, *(o for o in ("size", "source_size", "target", "copies", "taken") if o not in (doc_id, text, source)))
    size_, unit, source_ = (unused(base, c) for c in ("_size", "_unit", "_source"))
    keyed = base.withColumns({
        size_: word_count(text),
        unit: F.md5(F.concat_ws(
            "\x00", F.col(doc_id).isNull().cast("string"), F.col(doc_id).cast("string"), F.col(source).isNull().cast("string"),
            F.col(source).cast("string"), text_key(text),
        ).cast("binary")),
        source_: F.col(source).cast("string"),
    })
    rows = materialize(
        keyed.groupBy(F.col(unit).alias("_unit"), F.col(source_).alias("source")).agg(
            F.max(size_).alias("size"), (F.count("*") * F.max(size_)).cast("double").alias("mass")
        ), "mix-units",
    )
    shares = targets(rows.groupBy("source").agg(F.sum("mass").cast("long").alias("source_size")), weights)
    shares = materialize(shares.withColumnRenamed("source", "_s"), "mix-targets")
    owed = rows.join(shares, F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("_unit").alias("id"), "source", "size", "mass", "source_size", "target",
        (F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("ratio"),
    )
    whole = F.when(F.abs(F.col("ratio") - F.round("ratio")) < NEAR, F.round("ratio")).otherwise(F.floor("ratio"))
    owed = owed.withColumns({"whole": whole.cast("long"), "p": F.col("ratio") - whole})
    open_units = owed.where(f"mass > 0 and p > {NEAR}").select("id", "source", "mass", "p")
    rounded = round_fractions(open_units, seed)
    decided = owed.join(rounded, "id", "left").select(
        F.col("id").alias(unit), "source_size", "target",
        F.when(F.col("mass") > 0, F.col("whole") + F.coalesce("copy", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("copies"),
    )
    return keyed.join(decided, unit).select(
        *[f"`{c}`" for c in base.columns], F.col(size_).alias("size"), "source_size", "target", "copies",
        (F.col("copies") * F.col(size_)).alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, in the columns of the input."""
    found = with_mix(docs, **options)
    return found.where("copies > 0").withColumn(unused(found, "_n"), F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[f"`{c}`" for c in docs.columns if c in found.columns]
    )
