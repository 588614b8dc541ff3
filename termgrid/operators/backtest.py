"""The time-based backtests: baselines, logistic regression, random forest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgrid.operators.forests import HistogramForest, HistogramForestModel
from termgrid.operators.history import FeatureTable, model_features
from termgrid.operators.metrics import TIE_REASONS, score_metrics, with_scopes
from termgrid.operators.ordering import quantile_from_counts, value_counts
from termgrid.sources.scratch import materialize, spread
from termgrid.spec import COURSE_TERM_KEY, MIN_SUPPORT, RANDOM_STATE, RECALL_FRACTION, STABLE_TERM_KEY

# Model inputs of the trajectory backtest.
TRAJECTORY_NUMERIC = (
    "course_level", "lag1_w_mark_share", "lag2_w_mark_share", "lag3_w_mark_share",
    "lag1_grade_point_mean", "lag2_grade_point_mean", "lag3_grade_point_mean", "lag1_log_demand_proxy",
)
CATEGORICAL = ("subject", "term")
PREDICTION_CONTEXT = (
    *STABLE_TERM_KEY, "course_variant", "title", "w", "students", "grade_point_mean", "w_proxy",
    "w_mark_share", "demand_proxy", "term_match_mode", "instructor_count", "instructors_observed",
)


def scale_parameters(train: DataFrame, columns) -> DataFrame:
    """Per feature: exact train median, then mean and population deviation after filling.

    All features go through one (feature, value, count) table.
    """
    doubles = train.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    long = doubles.unpivot([], list(columns), "feature", "value")
    counts = value_counts(long, "value", ["feature"]).table
    middle = counts.groupBy("feature").agg(
        quantile_from_counts("value", 0.5).alias("median"), F.sum("n").alias("present"),
        F.sum(F.col("value") * F.col("n")).alias("total"),
    )
    size = long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))
    absent = F.col("rows") - F.col("present")
    centre = middle.join(size, "feature").select(
        "feature", "median", "rows", absent.alias("missing"),
        ((F.col("total") + absent * F.col("median")) / F.col("rows")).alias("mean"),
    )
    off = lambda value: (value - F.col("mean")) * (value - F.col("mean"))
    spread = counts.select("feature", "value", "n").join(centre, "feature").groupBy(
        "feature", "median", "mean", "missing", "rows"
    ).agg(F.sum(F.col("n") * off(F.col("value"))).alias("squares"))
    squares = F.col("squares") + F.col("missing") * off(F.col("median"))
    return spread.select(
        "feature", "median", "mean", F.sqrt(squares / F.col("rows")).alias("std"), "missing", "rows"
    )


def scaled(df: DataFrame, parameters) -> DataFrame:
    """Fill with the median and standardise; a constant feature is only centred."""
    out = {}
    for row in parameters:
        column = F.coalesce(F.nanvl(F.col(row["feature"]).cast("double"), F.lit(None)), F.lit(row["median"]))
        out[f"z_{row['feature']}"] = (column - F.lit(row["mean"])) / F.lit(row["std"] or 1.0)
    return df.withColumns(out)


@dataclass
class Preparation:
    """Train-fitted preprocessing and the names of the vector's slots."""

    parameters: list
    indexer: StringIndexerModel
    categorical: list[str]
    drop_reference: bool
    names: list[tuple[str, str, str]] = field(default_factory=list)  # (feature, parent, level)

    def apply(self, df: DataFrame) -> DataFrame:
        df = df.fillna({c: labels[0] for c, labels in zip(self.categorical, self.indexer.labelsArray)})
        return self.assembled.transform(self.indexer.transform(scaled(df, self.parameters)))


def prepare(train: DataFrame, numeric, categorical=CATEGORICAL, drop_reference: bool = False) -> Preparation:
    """Median fill and scaling for numbers, one-hot for categories; unknown levels are zeros.

    ``drop_reference`` leaves out each category's most frequent level.
    """
    categorical = list(categorical)
    parameters = sorted(scale_parameters(train, numeric).collect(), key=lambda r: list(numeric).index(r["feature"]))
    indexer = StringIndexer(
        inputCols=categorical, outputCols=[f"i_{c}" for c in categorical],
        handleInvalid="keep", stringOrderType="frequencyDesc",
    ).fit(train)
    prep = Preparation(parameters, indexer, categorical, drop_reference)
    prep.names = [(r["feature"], "", "") for r in parameters]
    stages, inputs = [], [f"z_{r['feature']}" for r in parameters]
    stages.append(OneHotEncoder(
        inputCols=[f"i_{c}" for c in categorical], outputCols=[f"o_{c}" for c in categorical],
        dropLast=True, handleInvalid="keep",
    ))
    for c, labels in zip(categorical, indexer.labelsArray):
        first = 1 if drop_reference else 0
        kept = list(range(first, len(labels)))
        if kept:
            stages.append(VectorSlicer(inputCol=f"o_{c}", outputCol=f"s_{c}", indices=kept))
            inputs.append(f"s_{c}")
        prep.names += [(f"{c}_{labels[i]}", c, labels[i]) for i in kept]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    prep.assembled = Pipeline(stages=stages).fit(indexer.transform(scaled(train, parameters)))
    return prep


def balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """Weight n / (2 * rows of the class)."""
    sizes = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    total = sum(sizes.values())
    weight = F.lit(None).cast("double")
    for value, size in sizes.items():
        weight = F.when(F.col(label) == value, total / (2.0 * size)).otherwise(weight)
    return train.withColumn("weight", weight)


def logistic(rows: int, max_iter: int = 1000) -> LogisticRegression:
    """L2 with C = 1: the weights sum to the row count, so the penalty is 1 / rows."""
    return LogisticRegression(
        labelCol="label", weightCol="weight", maxIter=max_iter, regParam=1.0 / rows,
        elasticNetParam=0.0, standardization=False,
    )


MAX_DEPTH = 30  # the most Spark grows; trees end earlier where nothing is left to split
LEAST_ROWS = 3  # of a leaf
FOREST_ROWS = 50_000  # Spark's own forest keeps a number per row and tree and looks up every node a row is at


def forest(trees: int, max_depth: int = MAX_DEPTH, seed: int = RANDOM_STATE) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol="label", weightCol="weight", numTrees=trees, maxDepth=max_depth,
        minInstancesPerNode=LEAST_ROWS, featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=1024,
        cacheNodeIds=True,  # a level starts at each row's node; without it every row walks every tree from its root again
    )


def forest_for(rows: int, trees: int, max_depth: int = MAX_DEPTH, seed: int = RANDOM_STATE):
    """Spark's forest, or beyond ``FOREST_ROWS`` the same kind of forest laid out for many rows."""
    return forest(trees, max_depth, seed) if rows <= FOREST_ROWS else HistogramForest(trees, max_depth, LEAST_ROWS, seed)


@dataclass
class Backtest:
    predictions: DataFrame
    metrics: DataFrame
    coefficients: DataFrame | None
    importance: DataFrame | None
    status: dict[str, str]
    models: dict
    certificate: DataFrame | None = None

    def status_rows(self, spark) -> DataFrame:
        """(model, status) rows, skipped models included."""
        return spark.createDataFrame(sorted(self.status.items()), "model string, status string")


def _scored(model, frame: DataFrame, keep) -> DataFrame:
    scored = model.transform(frame).withColumn("predicted_probability", vector_to_array("probability")[1])
    return scored.select(*keep, "predicted_probability")


def _with_errors(predictions: DataFrame, actual: str) -> DataFrame:
    error = F.col("predicted_probability") - F.col(actual)
    return predictions.withColumns({
        "prediction_error": error, "absolute_prediction_error": F.abs(error),
        "uncertainty_interval_status": F.lit("not_calculated_for_binary_screening"),
    })


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def trajectory_targets(lagged: DataFrame) -> DataFrame:
    return lagged.where("eligible_target")


def baseline_predictions(targets: DataFrame) -> DataFrame:
    """Constant prevalence and persistence of the last year's flag, both splits."""
    prevalence = targets.where(F.col("split") == "train").agg(F.avg("w_flag").alias("p")).first()["p"]
    if prevalence is None or targets.where(F.col("split") == "holdout").isEmpty():
        raise ValueError("the backtest needs training and holdout rows")
    context = [c for c in PREDICTION_CONTEXT if c in targets.columns]
    guesses = F.array(
        F.struct(F.lit("constant_baseline").alias("model"), F.lit(float(prevalence)).alias("p")),
        F.struct(
            F.lit("persistence_baseline").alias("model"),
            F.coalesce(F.col("lag1_w_flag").cast("double"), F.lit(float(prevalence))).alias("p"),
        ),
    )
    rows = targets.select(*context, "split", F.col("w_flag").alias("actual_w_flag"), F.explode(guesses).alias("g"))
    rows = rows.select(
        *context, "split", "actual_w_flag", F.col("g.model").alias("model"),
        F.col("g.p").alias("predicted_probability"),
        (F.col("g.p") >= 0.5).cast("long").alias("predicted_w_flag"),
    )
    return _with_errors(rows, "actual_w_flag")


def trajectory_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics per model, split and scope (all, spring, fall); tied baselines withhold recall@k."""
    withheld = F.col("model").isin(*TIE_REASONS)
    metrics = score_metrics(
        with_scopes(predictions), ["model", "split", "scope"], "actual_w_flag", "predicted_probability",
        "predicted_w_flag", tie_order=STABLE_TERM_KEY, withheld=withheld,
    )
    reason = F.lit(None).cast("string")
    for model, text in TIE_REASONS.items():
        reason = F.when(F.col("model") == model, text).otherwise(reason)
    return metrics.withColumn("recall_at_k_not_applicable_reason", reason)


def coefficient_table(model, prep: Preparation, train: DataFrame) -> DataFrame:
    """Signed coefficients with odds ratios and the support behind each category.

    The rows that reach the driver are the model's coefficients, one per feature.
    """
    spark = train.sparkSession
    references = {c: labels[0] for c, labels in zip(prep.categorical, prep.indexer.labelsArray)}
    listed = [
        (name, parent, level, references.get(parent, "") if prep.drop_reference else "", float(value))
        for (name, parent, level), value in zip(prep.names, model.coefficients.toArray())
    ]
    rows = spark.createDataFrame(
        listed, "feature string, parent string, level string, reference_category string, coefficient double"
    )
    numeric_names = [name for name, parent, _ in prep.names if not parent]
    counts = train.agg(*[F.count(c).alias(c) for c in numeric_names]).unpivot([], numeric_names, "level", "n")
    support = [counts.select(F.lit("").alias("parent"), "level", "n")]
    for c in prep.categorical:
        support.append(train.groupBy(F.lit(c).alias("parent"), F.col(c).alias("level")).agg(F.count(F.lit(1)).alias("n")))
    support = _union(support)
    own = support.select(
        F.col("parent").alias("p1"), F.col("level").alias("l1"), F.col("n").alias("sample_support"))
    reference = support.select(
        F.col("parent").alias("p2"), F.col("level").alias("l2"), F.col("n").alias("reference_support"))
    slot = F.when(F.col("parent") == "", F.col("feature")).otherwise(F.col("level"))
    rows = rows.join(own, (F.col("parent") == F.col("p1")) & (slot == F.col("l1")), "left")
    rows = rows.join(
        reference, (F.col("parent") == F.col("p2")) & (F.col("reference_category") == F.col("l2")), "left")
    value, categorical = F.col("coefficient"), F.col("parent") != ""
    return rows.select(
        "feature", "coefficient", F.abs(value).alias("abs_coefficient"),
        F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), value))).alias("odds_ratio"),
        F.when(value > 0, "higher odds").when(value < 0, "lower odds").otherwise("neutral").alias("direction"),
        F.when(categorical, "categorical").otherwise("numeric").alias("feature_type"),
        "reference_category", "sample_support",
        F.when(categorical, F.col("reference_support")).alias("reference_support"),
        F.when(categorical, F.lit(MIN_SUPPORT)).cast("long").alias("support_threshold"),
        F.coalesce(categorical & (F.col("sample_support") < MIN_SUPPORT), F.lit(False)).alias("low_support_warning"),
    ).orderBy(F.col("abs_coefficient").desc(), F.col("feature"))


INTERCEPT = "(intercept)"
STATIONARY = 1e-4  # largest slope that counts as none; the loss is a mean over rows with scaled inputs


def certificate_table(model, prep: Preparation, ready: DataFrame) -> DataFrame:
    """Is the fitted logistic regression the optimum?  Slope of the penalised loss at its coefficients, one row a slot.

    The loss is convex, so slopes of zero prove the fit whatever the optimiser did.
    They are sums over the train rows, taken per slot where its input isn't zero and
    map-side combined; the intercept carries no penalty.
    """
    pull = F.col("weight") * (vector_to_array("probability")[1] - F.col("label"))
    scored = model.transform(ready).select(
        F.array_insert(vector_to_array("features"), 1, F.lit(1.0)).alias("inputs"), "label", pull.alias("pull"), "weight")
    totals = scored.select("pull", "label", "weight", F.posexplode("inputs").alias("slot", "input")).where("input <> 0")
    slopes = totals.groupBy("slot").agg(F.sum(F.col("pull") * F.col("input")).alias("pull"))
    size = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("positives"), F.sum("weight").alias("weight")).first()
    reg = model.getRegParam()
    listed = [(0, INTERCEPT, float(model.intercept), 0.0)] + [
        (i + 1, prep.names[i][0], float(value), reg * float(value)) for i, value in enumerate(model.coefficients.toArray())]
    slots = ready.sparkSession.createDataFrame(listed, "slot int, feature string, coefficient double, penalty double")
    slope = F.coalesce(F.col("pull"), F.lit(0.0)) / F.lit(size["weight"]) + F.col("penalty")
    return slots.join(slopes, "slot", "left").select(
        "feature", "coefficient", slope.alias("slope"), (F.abs(slope) <= STATIONARY).alias("stationary"),
        F.lit(size["rows"]).alias("rows"), F.lit(size["positives"]).alias("positives"))


def importance_table(name: str, model, prep: Preparation, train: DataFrame) -> DataFrame:
    """Absolute coefficients (with their sign as direction) or forest importances."""
    if isinstance(model, HistogramForestModel):
        values, signs = model.importances, None
    elif hasattr(model, "featureImportances"):
        values, signs = model.featureImportances.toArray(), None
    else:
        signs = model.coefficients.toArray()
        values = abs(signs)
    listed = [
        (name, prep.names[i][0], float(values[i]), None if signs is None else float(signs[i]))
        for i in range(len(prep.names))
    ]
    return train.sparkSession.createDataFrame(
        listed, "model string, feature string, importance double, direction double"
    )


def _fit_models(train, features, label, prep_args, estimators):
    """Fit each estimator on the prepared train rows; one-class targets are skipped."""
    status, models = {}, {}
    classes = train.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
    if classes["low"] == classes["high"]:
        return None, None, {name: "skipped_one_class_training_target" for name in estimators}, models
    prep = prepare(train, features, **prep_args)
    ready = balanced_weights(prep.apply(train).withColumn("label", F.col(label).cast("double")), "label")
    # every level of a forest and every step of the optimiser passes over these rows: once from all cores, not from one small partition
    ready = materialize(spread(ready.select("features", "label", "weight")), "fit-rows")
    rows = ready.count()
    for name, make in estimators.items():
        try:
            models[name] = make(rows).fit(ready)
            status[name] = "fit"
        except (ValueError, TypeError, IllegalArgumentException) as error:
            # a model that can't be fitted to these rows leaves the others standing; lost executors and full disks are no result
            status[name] = f"skipped_fit_error: {type(error).__name__}"
    return prep, ready, status, models


def trajectory_backtest(
    lagged: DataFrame, models=("logistic_regression", "random_forest"), trees: int = 300, seed: int = RANDOM_STATE,
    max_depth: int = MAX_DEPTH,
) -> Backtest:
    """Baselines and models on the eligible targets; inputs are prior years plus level, subject, term."""
    targets = materialize(trajectory_targets(lagged), "targets")
    predictions = [baseline_predictions(targets)]
    train = targets.where(F.col("split") == "train")
    makers = {
        "logistic_regression": lambda rows: logistic(rows),
        "random_forest": lambda rows: forest_for(rows, trees, max_depth, seed),
    }
    prep, ready, status, fitted = _fit_models(
        train, TRAJECTORY_NUMERIC, "w_flag", {"drop_reference": True}, {m: makers[m] for m in models}
    )
    context = [c for c in PREDICTION_CONTEXT if c in targets.columns]
    for name, model in fitted.items():
        scored = _scored(model, prep.apply(targets), [*context, "split", "w_flag"])
        predictions.append(_with_errors(
            scored.withColumnRenamed("w_flag", "actual_w_flag")
            .withColumn("model", F.lit(name))
            .withColumn("predicted_w_flag", (F.col("predicted_probability") >= 0.5).cast("long")),
            "actual_w_flag",
        ))
    all_predictions = materialize(_union(predictions), "predictions")
    coefficients = certificate = None
    if "logistic_regression" in fitted:
        coefficients = coefficient_table(fitted["logistic_regression"], prep, train)
        certificate = certificate_table(fitted["logistic_regression"], prep, ready)
    importance = [importance_table(n, m, prep, train) for n, m in fitted.items()]
    return Backtest(
        all_predictions, trajectory_metrics(all_predictions), coefficients,
        _union(importance) if importance else None, status, fitted, certificate,
    )


def risk_backtest(
    table: FeatureTable, models=("logistic_regression", "random_forest"), trees: int = 250,
    fraction: float = RECALL_FRACTION, seed: int = RANDOM_STATE, max_depth: int = MAX_DEPTH,
) -> Backtest:
    """Majority baseline and models for the high-share label, train and holdout metrics."""
    rows = materialize(table.rows.where(F.col("high_w_risk").isNotNull()), "labelled")
    train = rows.where(F.col("split") == "train")
    rate = train.agg(F.avg("high_w_risk").alias("p")).first()["p"]
    if rate is None or rows.where(F.col("split") == "holdout").isEmpty():
        raise ValueError("both train and holdout must have labelled rows")
    keep = ["row_id", *COURSE_TERM_KEY, "split", "high_w_risk", "w_proxy"]
    baseline = rows.select(*keep, F.lit(float(rate)).alias("predicted_probability"), F.lit("majority_baseline").alias("model"))
    numeric_names, categorical = model_features(train)
    makers = {
        "logistic_regression": lambda n: logistic(n, 2000),
        "random_forest": lambda n: forest_for(n, trees, max_depth, seed),
    }
    prep, _, status, fitted = _fit_models(
        train, numeric_names, "high_w_risk", {"categorical": categorical}, {m: makers[m] for m in models}
    )
    scored = [
        _scored(model, prep.apply(rows), keep).withColumn("model", F.lit(name)) for name, model in fitted.items()
    ]
    everything = materialize(
        _union([baseline, *scored])
        .withColumn("predicted_high_w_risk", (F.col("predicted_probability") >= 0.5).cast("long"))
        .withColumn("threshold_used", F.lit(table.label.threshold)),
        "risk_predictions",
    )
    metrics = score_metrics(
        everything, ["model", "split"], "high_w_risk", "predicted_probability", "predicted_high_w_risk",
        fraction, tie_order=COURSE_TERM_KEY,
    )
    predictions = everything.where(F.col("model") != "majority_baseline").withColumnRenamed(
        "high_w_risk", "actual_high_w_risk"
    )
    importance = [importance_table(n, m, prep, train) for n, m in fitted.items()]
    return Backtest(predictions, metrics, None, _union(importance) if importance else None, status, fitted)
