"""Exact ranks, quantiles and running totals without a single-task window.

``rank().over(Window.orderBy(x))`` moves every row into one task.  Here the rows
are first grouped by the ordered value (map-side combined, so a value that holds
a third of all rows costs one row per task), and only the distinct values are
put in order:

1. a bounded, hash-chosen sample of the distinct values gives range bounds;
2. each value falls into a range bucket, a pure function of the value;
3. running totals inside a bucket come from a window per bucket, and totals of
   the earlier buckets from a window over at most ``BUCKETS + 1`` rows per group.

The sample only decides how even the buckets are; results are exact for any
sample.  With few distinct values (the sample is then the whole set) everything
is one bucket of known size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgrid.sources.scratch import materialize

BUCKETS = 256
SAMPLE_ROWS = 4096
# A table of at most this many values (some 10 MB) is broadcast, after counting it.
BROADCAST_ROWS = 500_000
# A value with at least 1/HOT_SHARE of all rows counts as hot; at most
# HOT_SHARE values can be, so their table is always small enough to broadcast.
HOT_SHARE = 1000


@dataclass
class RunningTotals:
    """Distinct ordered values with totals up to and including each value.

    ``table`` holds the group columns, the order columns, each weight, and
    ``<weight>_through`` (running total) and ``<weight>_total`` (group total).
    ``rows`` is the counted number of its rows.
    """

    table: DataFrame
    rows: int


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    weights: Mapping[str, Column],
    group_by: Sequence[str] = (),
    sample_rows: int = SAMPLE_ROWS,
    buckets: int = BUCKETS,
) -> RunningTotals:
    """Running totals of ``weights`` (sum expressions) in ascending ``order``.

    Rows with a null in an order column must be filtered out by the caller.
    ``group_by`` is for a few report groups (model, split, scope), not for keys.
    """
    order, group_by = list(order), list(group_by)
    # Written once: it is far smaller than the rows, and the sample and every later
    # read would otherwise run the rows' whole plan again.
    values = materialize(
        df.groupBy(*group_by, *order).agg(*[w.alias(n) for n, w in weights.items()]), "values"
    )
    types = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    single = len(order) == 1
    key = F.col(order[0]) if single else F.struct(*order)
    key_type = types[order[0]] if single else f"struct<{','.join(f'{c}:{types[c]}' for c in order)}>"
    sample = (
        values.select(*order).distinct()
        .orderBy(F.xxhash64(*order)).limit(sample_rows + 1)
        .orderBy(*order).collect()
    )
    small = len(sample) <= sample_rows
    if small:
        bucket = F.lit(0)
    else:
        step = max(1, len(sample) // buckets)
        literals = [[F.lit(row[c]) for c in order] for row in sample[step::step]]
        bucket = _bounds_below(key, key_type, [one[0] if single else F.struct(*one) for one in literals])
    values = values.withColumn("_bucket", bucket.cast("int"))

    in_bucket = Window.partitionBy(*group_by, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*group_by).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy(*group_by)
    if small:
        rows = values
        before = {n: F.lit(0) for n in weights}
        total = {
            n: F.sum(n).over(Window.partitionBy(*group_by, "_bucket")) for n in weights
        }
    else:
        offsets = values.groupBy(*group_by, "_bucket").agg(
            *[F.sum(n).alias(f"_sum_{n}") for n in weights]
        )
        offsets = offsets.select(
            *[F.col(g).alias(f"_g_{g}") for g in group_by],
            F.col("_bucket").alias("_g_bucket"),
            *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in weights],
            *[F.sum(f"_sum_{n}").over(everything).alias(f"_total_{n}") for n in weights],
        )
        on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group_by]
        on.append(F.col("_bucket") == F.col("_g_bucket"))
        rows = values.join(offsets, on)
        before = {n: F.col(f"_before_{n}") for n in weights}
        total = {n: F.col(f"_total_{n}") for n in weights}
    table = rows.select(
        *group_by, *order, *weights,
        *[(before[n] + F.sum(n).over(in_bucket)).alias(f"{n}_through") for n in weights],
        *[total[n].alias(f"{n}_total") for n in weights],
    )
    return RunningTotals(table, values.count())


def _bounds_below(key: Column, key_type: str, bounds: list[Column]) -> Column:
    """How many of the ascending bounds are below the key: groups of them by their last bound, then one group."""
    group = max(1, int(len(bounds) ** 0.5))

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda bound: bound < key))

    def array(some: list[Column]) -> Column:
        return F.array(*some).cast(f"array<{key_type}>")

    whole = below(array(bounds[group - 1::group])) * group
    return whole + below(F.slice(array(bounds), whole + 1, F.lit(group)))


def value_counts(df: DataFrame, value: str, group_by: Sequence[str] = (), **sizes) -> RunningTotals:
    """Running row counts over the non-null values of one column."""
    rows = df.where(F.col(value).isNotNull())
    return running_totals(rows, [value], {"n": F.count(F.lit(1))}, group_by, **sizes)


def quantile_from_counts(value: str, q: float) -> Column:
    """Aggregate over a ``value_counts`` table: linearly interpolated quantile."""
    position = (F.col("n_total") - 1) * F.lit(float(q))
    low = F.min(F.when(F.col("n_through") > F.floor(position), F.col(value)))
    high = F.min(F.when(F.col("n_through") > F.ceil(position), F.col(value)))
    part = F.max(position - F.floor(position))
    return low + (high - low) * part


def exact_quantile(counts: RunningTotals, value: str, q: float) -> float | None:
    return counts.table.agg(quantile_from_counts(value, q).alias("q")).first()["q"]


def _attached(df: DataFrame, value: str, rank: str, ranked: DataFrame, small: bool) -> DataFrame:
    """Join (``_value``, ``_n``, ``_total``, ``_rank``) to rows as ``rank``; rows without a value get null."""
    if small:
        table = F.broadcast(ranked.select("_value", F.col("_rank").alias(rank)))
        return df.join(table, F.col(value) == F.col("_value"), "left").drop("_value")
    is_hot = F.col("_n") * HOT_SHARE >= F.col("_total")
    hot = F.broadcast(ranked.where(is_hot).select(F.col("_value").alias("_hot"), F.col("_rank").alias("_hot_rank")))
    cold = ranked.where(~is_hot).select(F.col("_value").alias("_cold"), F.lit(0).alias("_cold_salt"), F.col("_rank").alias("_cold_rank"))
    rows = df.join(hot, F.col(value) == F.col("_hot"), "left")
    # rows that are settled (hot or without a value) go anywhere, the others to their value
    open_ = F.col("_hot_rank").isNull() & F.col(value).isNotNull()
    rows = rows.withColumns({
        "_key": F.when(open_, F.col(value)), "_salt": F.when(open_, 0).otherwise(F.monotonically_increasing_id() % 1_000_003 + 1).cast("int"),
    })
    rows = rows.join(cold, (F.col("_key") == F.col("_cold")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return rows.select(*[f"`{c}`" for c in df.columns], F.coalesce("_hot_rank", "_cold_rank").alias(rank))


def _descending() -> Column:
    return (F.col("n_total") - F.col("n_through") + 1).cast("long")


def with_rank(
    df: DataFrame, value: str, rank: str, counts: RunningTotals | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Descending min-rank of ``value`` (ties share the best rank); null stays unranked.

    Beyond ``broadcast_rows`` distinct values only the hot ones are broadcast; the
    other rows, none of whose values is frequent, join by shuffle.
    """
    counts = counts or value_counts(df, value)
    ranked = counts.table.select(
        F.col(value).alias("_value"), F.col("n").alias("_n"), F.col("n_total").alias("_total"), _descending().alias("_rank"))
    return _attached(df, value, rank, ranked, counts.rows <= broadcast_rows)


def measure_counts(df: DataFrame, values: Sequence[str], **sizes) -> RunningTotals:
    """Running row counts over the non-null values (``_value``) of several number columns (``_measure``), in one pass over the rows."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("_measure"), F.col(v).cast("double").alias("_value")) for v in values])))
    return running_totals(long.where("_value is not null"), ["_value"], {"n": F.count(F.lit(1))}, ["_measure"], **sizes)


def of_measure(counts: RunningTotals, value: str) -> DataFrame:
    return counts.table.where(F.col("_measure") == value).drop("_measure")


def with_ranks(
    df: DataFrame, ranks: Mapping[str, str], counts: RunningTotals | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Descending min-ranks of several number columns, named by ``ranks`` (column -> rank).

    All columns are counted and put in order together.  The rows are read once
    and every rank adds the same joins, so the plan grows with the number of ranks.
    """
    counts = counts or measure_counts(df, list(ranks))
    for value, rank in ranks.items():
        ranked = of_measure(counts, value).select(
            "_value", F.col("n").alias("_n"), F.col("n_total").alias("_total"), _descending().alias("_rank"))
        df = _attached(df, value, rank, ranked, counts.rows <= broadcast_rows)
    return df
