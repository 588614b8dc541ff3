"""Exact ranking and classification metrics per model, split and scope.

Rows are first grouped by score; every metric, the area measures included,
comes from running totals over the distinct scores, so ties are handled exactly
and no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgrid.operators.ordering import running_totals
from termgrid.spec import RECALL_FRACTION

# Why recall@k of a tied baseline is not reported.
TIE_REASONS = {
    "constant_baseline": "constant probabilities create arbitrary row ties; metric is intentionally not reported",
    "persistence_baseline": "discrete persistence scores create arbitrary row ties; metric is intentionally not reported",
}


def with_scopes(predictions: DataFrame) -> DataFrame:
    """Every row once under scope ``all`` and once under its own term."""
    return predictions.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("term"))))


def score_metrics(
    df: DataFrame,
    groups: Sequence[str],
    label: str,
    score: str,
    prediction: str,
    fraction: float = RECALL_FRACTION,
    tie_order: Sequence[str] = (),
    withheld: Column | None = None,
    **sizes,
) -> DataFrame:
    """One row per group with AP, ROC-AUC, Brier, confusion counts and recall@k.

    Recall@k counts the positives among the k = ceil(n * fraction) highest
    scores.  Rows tied at the cut-off are taken in ``tie_order``, which must
    identify a row within its group.  ``withheld`` (over the group columns) marks
    groups whose recall@k is not reported.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    groups = list(groups)
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("_order", -F.col(score))
    y, guess = F.col(label).cast("long"), F.col(prediction).cast("long")
    weights = {"n": F.count(F.lit(1)), "pos": F.sum(y), "hit": F.sum(y * guess), "said": F.sum(guess)}
    by_score = running_totals(rows, ["_order"], weights, groups, **sizes).table
    value = -F.col("_order")
    neg = F.col("n") - F.col("pos")
    neg_below = (F.col("n_total") - F.col("pos_total")) - (F.col("n_through") - F.col("pos_through"))
    by_score = by_score.withColumn(
        "_k", F.greatest(F.lit(1), F.ceil(F.col("n_total") * F.lit(float(fraction)))).cast("long")
    )
    before = F.col("n_through") - F.col("n")
    cut = (before < F.col("_k")) & (F.col("n_through") > F.col("_k"))
    totals = by_score.groupBy(*groups).agg(
        F.max("n_total").alias("rows"), F.max("pos_total").alias("positive_count"),
        F.sum(F.col("pos") * F.col("pos_through") / F.col("n_through")).alias("_ap"),
        F.sum(F.col("pos") * (neg_below + neg / 2)).alias("_auc"),
        F.sum(F.col("pos") * (1 - value) * (1 - value) + neg * value * value).alias("_brier"),
        F.max("hit_total").alias("_tp"), F.max("said_total").alias("_said"), F.max("_k").alias("_k"),
        F.sum(F.when(F.col("n_through") <= F.col("_k"), F.col("pos")).otherwise(0)).alias("_above"),
        F.max(F.when(cut, F.col("_order"))).alias("_cut"),
        F.max(F.when(cut, F.col("_k") - before)).alias("_need"),
    )
    tied_positive = F.lit(0)
    if tie_order:
        # One cut-off per group; only the rows tied at it are ordered.
        shown = ~withheld if withheld is not None else F.lit(True)
        cuts = totals.where(F.col("_cut").isNotNull() & shown).select(*[F.col(g).alias(f"_g_{g}") for g in groups], "_cut", "_need")
        on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups] + [F.col("_order") == F.col("_cut")]
        tied = rows.join(cuts, on).select(*groups, *tie_order, F.col(label), "_need")
        in_order = running_totals(
            tied, list(tie_order), {"n": F.count(F.lit(1)), "pos": F.sum(y), "need": F.max("_need")}, groups, **sizes
        ).table
        taken = in_order.where(F.col("n_through") <= F.col("need")).groupBy(
            *[F.col(g).alias(f"_g_{g}") for g in groups]
        ).agg(F.sum("pos").alias("_tied"))
        totals = totals.join(taken, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups], "left")
        tied_positive = F.coalesce(F.col("_tied"), F.lit(0))
    n, p = F.col("rows"), F.col("positive_count")
    q = n - p
    tp = F.col("_tp")
    fp, fn = F.col("_said") - tp, p - tp
    tn = q - fp
    both = (p > 0) & (q > 0)
    blocked = withheld if withheld is not None else F.lit(False)
    if not tie_order:
        blocked = blocked | F.col("_cut").isNotNull()
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    in_top = F.when(both & ~blocked, F.col("_above") + tied_positive)
    return totals.select(
        *groups, "rows", "positive_count", q.alias("negative_count"),
        F.when(both, "ok").otherwise("one_class").alias("status"),
        F.when(both, F.col("_ap") / p).alias("average_precision_ap"),
        F.when(both, F.col("_auc") / (p * q)).alias("roc_auc"),
        (F.col("_brier") / n).alias("brier_score"),
        share(tp, F.col("_said")).alias("precision"), share(tp, p).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.when(both, (tp / p + tn / q) / 2).alias("balanced_accuracy"),
        *[F.when(both, c).alias(name) for name, c in (("tn", tn), ("fp", fp), ("fn", fn), ("tp", tp))],
        (in_top / p).alias("recall_at_k"), in_top.alias("positive_in_top_k"),
        F.col("_k").alias("recall_at_k_rows"),
        F.when(blocked, "not_applicable_ties").otherwise("computed").alias("recall_at_k_status"),
    )


def metrics_long(metrics: DataFrame, fields: Sequence[str], ids: Sequence[str] = ("model",)) -> DataFrame:
    """Wide metric columns as (ids, metric, value) rows."""
    return metrics.unpivot(list(ids), list(fields), "metric", "value")
