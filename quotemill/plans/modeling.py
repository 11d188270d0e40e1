"""Feature preparation, class-weighted classifiers on MLlib, and the walk-forward search.

``fit_boosted`` is in :mod:`quotemill.plans.boosting`.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import argmax_class, label_index
from quotemill.plans.boosting import Boosted, fit_boosted  # noqa: F401
from quotemill.plans.evaluation import (
    PROBABILITIES,
    confusion_counts,
    f1_scores,
    log_loss,
)
from quotemill.plans.labels import with_class_weights
from quotemill.plans.splits import (
    assert_no_leakage,
    chronological_split,
    fold_table,
    sample_symbols,
    split_bounds,
    walk_forward_splits,
)
from quotemill.plans.tuning import Space, TrialStore, fold_rows, propose
from quotemill.schemas import MAX_SPAN_DAYS, NON_FEATURE_COLUMNS
from quotemill.session import staged, work_path

# Share of symbols searched on, folds, finalists.
SEARCH_FRACTION = 0.3
N_FOLDS = 5
FINALISTS = 3

Params = dict[str, float]


class FeatureSetError(AssertionError):
    """The dataset's features are not the ones the experiments list."""


def select_model_features(df: DataFrame) -> DataFrame:
    """All columns but the non-features, and the label."""
    dropped = [c for c in NON_FEATURE_COLUMNS if c != "label"]
    return df.drop(*dropped)


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NON_FEATURE_COLUMNS]


def prepare_model_features(df: DataFrame, features: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Features as float and the label as a class index ``y``."""
    names = feature_names(df) if features is None else list(features)
    return df.select(*keep, *[F.col(c).cast("float").alias(c) for c in names], label_index("label").alias("y"))


def assert_feature_set(df: DataFrame, expected: Sequence[str]) -> None:
    found = set(feature_names(df))
    if found != set(expected):
        raise FeatureSetError(f"feature columns differ: {sorted(found ^ set(expected))}")


def _filled(names: Sequence[str]) -> tuple[list[Column], list[str]]:
    """MLlib has no missing values: fill with 0 and add a marker column per feature."""
    columns, inputs = [], []
    for c in names:
        value = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        columns += [
            F.coalesce(value, F.lit(0.0)).alias(f"_f_{c}"),
            value.isNull().cast("double").alias(f"_m_{c}"),
        ]
        inputs += [f"_f_{c}", f"_m_{c}"]
    return columns, inputs


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One ``features`` vector per row next to the kept columns."""
    columns, inputs = _filled(features)
    flat = df.select(*keep, *columns)
    vector = VectorAssembler(inputCols=inputs, outputCol="features").transform(flat)
    return vector.select(*keep, "features")


@dataclass
class Forest:
    """A class-weighted random forest over the three classes."""

    features: list[str]
    model: object

    def predict(self, df: DataFrame) -> DataFrame:
        """The rows with ``p_down``, ``p_hold`` and ``p_up``."""
        names = df.columns
        flat, inputs = _filled(self.features)
        vectors = VectorAssembler(inputCols=inputs, outputCol="features").transform(df.select(*names, *flat))
        p = vector_to_array(F.col("probability"))
        return self.model.transform(vectors).select(
            *names, *[p[i].alias(c) for i, c in enumerate(PROBABILITIES)]
        )


def _training_rows(train: DataFrame, features: Sequence[str]) -> DataFrame:
    weighted = with_class_weights(train, "label", "_weight")
    rows = weighted.withColumn("_y", label_index("label").cast("double"))
    return assemble(rows, features, ["_y", "_weight"])


def fit_forest(train: DataFrame, features: Sequence[str], params: Params | None = None, seed: int = 0) -> Forest:
    """Fit a random forest; the class weights make the three classes count alike."""
    params = params or {}
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="_y",
        weightCol="_weight",
        seed=seed,
        numTrees=int(params.get("n_trees", 20)),
        maxDepth=int(params.get("max_depth", 5)),
        minInstancesPerNode=max(1, int(params.get("min_rows", 1))),
        subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy=str(params.get("colsample", "auto")),
        maxBins=int(params.get("max_bin", 32)),
    )
    return Forest(list(features), forest.fit(_training_rows(train, features)))


def xgboost_available() -> bool:
    """Whether the optional distributed XGBoost estimator can be imported."""
    try:
        import xgboost.spark  # noqa: F401
    except ImportError:
        return False
    return True


def score_predictions(predicted: DataFrame, weighted: bool = True) -> DataFrame:
    """One row: macro F1 over all classes and the (class-weighted) log loss."""
    rows = predicted.withColumn("y", label_index("label")).withColumn("pred", argmax_class(*PROBABILITIES))
    f1 = f1_scores(confusion_counts(rows), all_classes=True).select("macro_f1")
    if weighted:
        rows = with_class_weights(rows, "label", "_weight")
        p = F.element_at(F.array(*[F.col(c) for c in PROBABILITIES]), (F.col("y") + 1).cast("int"))
        loss = rows.agg(
            (F.sum(-F.log(F.greatest(p, F.lit(1e-15))) * F.col("_weight")) / F.sum("_weight")).alias("log_loss")
        )
    else:
        loss = rows.agg(log_loss(F.col("y"), PROBABILITIES).alias("log_loss"))
    return f1.withColumn("log_loss", loss.scalar())


def pareto_front(trials: DataFrame) -> DataFrame:
    """Trials no other trial beats: none has a loss as low and an F1 as high, one of them better.

    One row per trial, so the table is as small as the search.
    """
    # By rising loss, a trial is on the front if it has the best F1 of its loss, and a better one than
    # every lower loss; so one pass over the sorted losses finds it, without comparing pairs.
    best = trials.groupBy("log_loss").agg(F.max("macro_f1").alias("_best"))
    lower = Window.orderBy("log_loss").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_lower", F.max("_best").over(lower))
    ahead = F.col("_lower").isNull() | (F.col("macro_f1") > F.col("_lower"))
    front = trials.join(best, "log_loss").where((F.col("macro_f1") == F.col("_best")) & ahead)
    return front.select(*trials.columns)


def best_trials(front: DataFrame, n: int = FINALISTS) -> DataFrame:
    """The front's first trials by F1, then by loss."""
    return front.orderBy(F.desc("macro_f1"), F.asc("log_loss"), "trial").limit(n)


def grid(space: dict[str, Sequence[float]]) -> list[Params]:
    names = list(space)
    return [dict(zip(names, values)) for values in itertools.product(*[space[n] for n in names])]


@dataclass
class SearchResult:
    """The trial table, the chosen parameters, the refitted model and its scores."""

    trials: DataFrame
    params: Params
    model: Forest | Boosted
    key: tuple[float, float]


def walk_forward_tune(
    spark: SparkSession,
    dataset: DataFrame,
    features: Sequence[str],
    space: Space,
    n_folds: int = N_FOLDS,
    fraction: float = SEARCH_FRACTION,
    seed: int = 0,
    n_finalists: int = FINALISTS,
    check_leakage: bool = True,
    n_trials: int | None = None,
    store: str | None = None,
    boosted: bool = False,
) -> SearchResult:
    """Search parameters on walk-forward folds of a symbol sample, refit the best on all symbols.

    Fold boundaries come from the whole dataset's dates. The dataset should be a stored table: each fit reads its date
    ranges. Without ``n_trials`` every combination of the listed values is a trial; with it, trials are
    proposed from those before (:func:`quotemill.plans.tuning.propose`), also within a ``Range``. Finished trials are kept in
    ``store``; a search broken off goes on with them, if its settings are the same. ``boosted`` fits stop early on
    the fold's validation rows. What comes back to the driver is one score row per fit.
    """
    splits = chronological_split(dataset)
    sample = staged(sample_symbols(dataset, fraction, seed), "search-rows")
    folds = fold_table(dataset.select("date"), n_folds).collect()
    if check_leakage:
        listed = walk_forward_splits(sample, n_folds, boundary_dates=dataset.select("date"))
        assert_no_leakage(listed, split_bounds(dataset))
    if n_trials is None:
        listed_params = grid(space)
    settings = {"fraction": fraction, "seed": seed, "n_folds": n_folds, "boosted": boosted, "features": list(features)}
    settings |= {"folds": [[str(v) for v in f] for f in folds], "space": {k: str(v) for k, v in space.items()}}
    kept = TrialStore(spark, store or work_path(spark, "trials"), settings)

    def fit(train: DataFrame, val: DataFrame, params: Params) -> Forest | Boosted:
        return fit_boosted(train, val, features, params, seed) if boosted else fit_forest(train, features, params, seed)

    done = kept.trials()
    for trial in range(len(listed_params) if n_trials is None else n_trials):
        if any(t["trial"] == trial for t in done):
            continue
        params = listed_params[trial] if n_trials is None else propose(space, done, trial, seed)
        # Row minimums are on the full scale, the folds hold only a share of the symbols.
        scaled = {**params, **({"min_rows": params["min_rows"] * fraction} if "min_rows" in params else {})}
        scores = []
        for fold in folds:
            train, val = fold_rows(sample, folds, fold["fold"], MAX_SPAN_DAYS)
            model = fit(train, val, scaled)
            score = score_predictions(model.predict(val)).first().asDict()
            if boosted:
                score["best_iteration"] = model.best_round
            scores.append(score)
        kept.add(trial, params, scores)
        done = kept.trials()
    trials = kept.table().drop("folds")
    train, val = splits.where(F.col("split") == "train"), splits.where(F.col("split") == "val")
    best = None
    for trial in best_trials(pareto_front(trials), n_finalists).collect():
        params = json.loads(trial["params"])
        model = fit(train, val, params)
        score = score_predictions(model.predict(val)).first()
        key = (score["macro_f1"], -score["log_loss"])
        if best is None or key > best.key:
            best = SearchResult(trials, params, model, key)
    return best


def importance_by_group(spark: SparkSession, model: Forest, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Share of the model's total importance that falls on each group of features."""
    weights = model.model.featureImportances.toArray()
    # Two inputs per feature: its value and its missing marker.
    per_feature = {c: float(weights[2 * i] + weights[2 * i + 1]) for i, c in enumerate(model.features)}
    rows = [(name, sum(per_feature.get(c, 0.0) for c in members)) for name, members in groups.items()]
    return spark.createDataFrame(rows, "feature_group string, share double")


# Saved models.


def save_model(spark: SparkSession, model: Forest | Boosted, path: str, metadata: dict | None = None) -> None:
    """Save a model with a one-row JSON table of what reproduces its evaluation."""
    boosted = isinstance(model, Boosted)
    stages = model.pipeline() if boosted else PipelineModel([model.model])
    stages.write().overwrite().save(f"{path}/model")
    info = {"feature_columns": model.features, **(metadata or {})}
    if boosted:
        info |= {"boosting": model.settings(), "best_iteration": model.best_round}
    line = spark.createDataFrame([(json.dumps(info, sort_keys=True, default=str),)], "value string")
    line.write.mode("overwrite").text(f"{path}/metadata")


def load_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def load_model(spark: SparkSession, path: str) -> Forest | Boosted:
    info, stages = load_metadata(spark, path), PipelineModel.load(f"{path}/model").stages
    if "boosting" not in info:
        return Forest(info["feature_columns"], stages[0])
    kept = info["boosting"]
    losses = [tuple(pair) for pair in kept["losses"]]
    return Boosted(info["feature_columns"], kept["gappy"], kept["learning_rate"], list(stages), losses)


def load_saved_params(spark: SparkSession, path: str, study_name: str, start_date: str) -> Params:
    """Parameters of the saved model, which must come from the same study and start date."""
    info = load_metadata(spark, path)
    if info.get("study_name") != study_name or info.get("start_date") != start_date:
        raise ValueError(
            f"the saved model is from study {info.get('study_name')} starting "
            f"{info.get('start_date')}, expected {study_name} from {start_date}"
        )
    return info["params"]
