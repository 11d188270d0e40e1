"""Joint boosting of the three classes: one softmax, a regression tree per class and round, one early stop.

MLlib's boosted trees know two classes. Here every round fits three of its regression trees, one per class, to the Newton
step of the common class-weighted log loss: the target of a row is its gradient over its curvature and its weight the
curvature, so the mean in a leaf is the step that the leaf should take.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.scalars import label_index
from quotemill.plans.evaluation import PROBABILITIES
from quotemill.plans.labels import with_class_weights
from quotemill.session import staged

CLASSES = range(len(PROBABILITIES))
MARGINS = [f"_margin_{k}" for k in CLASSES]
# Missing values lie beyond all others, on either side.
FAR = 1e30
# Curvatures below this count as this, so that rows that are surely right do not ask for endless steps.
LEAST_CURVATURE = 1e-6
# After so many rounds the margins are written, so that a lost executor repeats few trees.
ROUNDS_PER_WRITE = 5
# Rounds without a better validation loss before the fit ends.
PATIENCE = 10


def inputs(features: Sequence[str], gappy: Sequence[str]) -> tuple[list[Column], list[str]]:
    """Columns of the trees' input vector.

    A feature with missing values is there twice, with them below and above all others. A split on the first copy sends
    them left, one on the second right, so a tree learns the direction with the split.
    """
    columns = []
    for c in features:
        value = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        columns.append(F.coalesce(value, F.lit(-FAR)).alias(f"_low_{c}"))
        if c in gappy:
            columns.append(F.coalesce(value, F.lit(FAR)).alias(f"_high_{c}"))
    names = [f"_low_{c}" for c in features] + [f"_high_{c}" for c in features if c in gappy]
    return columns, names


def assembled(df: DataFrame, features: Sequence[str], gappy: Sequence[str], keep: Sequence[str]) -> DataFrame:
    columns, names = inputs(features, gappy)
    flat = df.select(*keep, *columns)
    return VectorAssembler(inputCols=names, outputCol="features").transform(flat).select(*keep, "features")


def softmax(margins: Sequence[str]) -> list[Column]:
    """Probabilities from margins; the largest is taken off first, so no power overflows."""
    top = F.greatest(*margins)
    powers = [F.exp(F.col(m) - top) for m in margins]
    total = powers[0]
    for power in powers[1:]:
        total = total + power
    return [power / total for power in powers]


@dataclass
class Boosted:
    """Trees of all rounds (three each), how far a round goes, and the losses ``(train, validation)`` by round."""

    features: list[str]
    gappy: list[str]
    learning_rate: float
    trees: list = field(default_factory=list)
    losses: list[tuple[float, float]] = field(default_factory=list)

    @property
    def best_round(self) -> int:
        """The number of rounds with the least validation loss."""
        return min(range(len(self.losses)), key=lambda r: self.losses[r][1]) + 1 if self.losses else 0

    def predict(self, df: DataFrame, rounds: int | None = None) -> DataFrame:
        """The rows with ``p_down``, ``p_hold`` and ``p_up`` after the best, or the named, number of rounds."""
        names = df.columns
        columns, vector = inputs(self.features, self.gappy)
        out = VectorAssembler(inputCols=vector, outputCol="features").transform(df.select(*names, *columns)).select(*names, "features")
        chosen = self.trees[: len(CLASSES) * (self.best_round if rounds is None else rounds)]
        for tree in chosen:
            out = tree.transform(out)
        margins = []
        for k in CLASSES:
            total = F.lit(0.0)
            for tree in chosen[k :: len(CLASSES)]:
                total = total + F.lit(self.learning_rate) * F.col(tree.getPredictionCol())
            margins.append(total.alias(MARGINS[k]))
        scored = out.select(*names, *margins)
        return scored.select(*names, *[p.alias(c) for p, c in zip(softmax(MARGINS), PROBABILITIES, strict=True)])

    def pipeline(self) -> PipelineModel:
        return PipelineModel(self.trees)

    def settings(self) -> dict:
        return {"gappy": self.gappy, "learning_rate": self.learning_rate, "losses": self.losses}


def _rows(df: DataFrame, features: Sequence[str], gappy: Sequence[str], is_val: bool) -> DataFrame:
    rows = with_class_weights(df, "label", "_weight").withColumn("_y", label_index("label").cast("int"))
    rows = assembled(rows, features, gappy, ["_y", "_weight"])
    return rows.withColumn("_val", F.lit(is_val))


def _losses(rows: DataFrame) -> tuple[float, float]:
    """Class-weighted log loss of the training and of the validation rows."""
    hit = F.get(F.array(*softmax(MARGINS)), F.col("_y"))
    loss = F.sum(-F.log(F.greatest(hit, F.lit(1e-15))) * F.col("_weight")) / F.sum("_weight")
    found = {r["_val"]: r.loss for r in rows.groupBy("_val").agg(loss.alias("loss")).collect()}
    return found.get(False, float("nan")), found.get(True, found.get(False, float("nan")))


def fit_boosted(
    train: DataFrame, val: DataFrame, features: Sequence[str], params: dict[str, float] | None = None, seed: int = 0
) -> Boosted:
    """Fit at most ``n_trees`` rounds, until the validation loss over all classes has not fallen for ``patience`` rounds.

    ``params``: ``n_trees``, ``max_depth``, ``learning_rate``, ``subsample`` (rows of a round), ``min_rows`` of a leaf, ``max_bin``,
    ``patience``. Rows of either part weigh their classes alike. Without validation rows the training loss decides. Missing
    values go the way that the training rows show, in every split.
    """
    params, features = params or {}, list(features)
    gaps = train.agg(*[F.count_if(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).isNull()).alias(c) for c in features]).first()
    gappy = [c for c in features if gaps[c]]
    rate, subsample = float(params.get("learning_rate", 0.1)), float(params.get("subsample", 1.0))
    patience = int(params.get("patience", PATIENCE))
    rows = _rows(train, features, gappy, False).unionByName(_rows(val, features, gappy, True))
    rows = staged(rows.select("*", F.monotonically_increasing_id().alias("_id"), *[F.lit(0.0).alias(m) for m in MARGINS]), "boosting")
    model = Boosted(features, gappy, rate)
    for turn in range(int(params.get("n_trees", 20))):
        part = rows.where(~F.col("_val"))
        if subsample < 1:
            part = part.where(F.pmod(F.xxhash64("_id", F.lit(seed), F.lit(turn)), F.lit(1 << 20)) < subsample * (1 << 20))
        for k, p in zip(CLASSES, softmax(MARGINS), strict=True):
            curvature = F.greatest(p * (1 - p), F.lit(LEAST_CURVATURE))
            step = ((F.col("_y") == k).cast("double") - p) / curvature
            tree = DecisionTreeRegressor(
                featuresCol="features",
                labelCol="_step",
                weightCol="_share",
                predictionCol=f"_tree_{turn}_{k}",
                maxDepth=int(params.get("max_depth", 3)),
                minInstancesPerNode=max(1, int(params.get("min_rows", 1))),
                maxBins=int(params.get("max_bin", 32)),
                seed=seed + len(CLASSES) * turn + k,
            )
            model.trees.append(tree.fit(part.select("features", step.alias("_step"), (F.col("_weight") * curvature).alias("_share"))))
        for tree, margin in zip(model.trees[-len(CLASSES) :], MARGINS, strict=True):
            rows = tree.transform(rows)
            rows = rows.withColumn(margin, F.col(margin) + F.lit(rate) * F.col(tree.getPredictionCol())).drop(tree.getPredictionCol())
        if (turn + 1) % ROUNDS_PER_WRITE == 0:
            rows = staged(rows, "boosting")
        model.losses.append(_losses(rows))
        if turn + 1 - model.best_round >= patience:
            break
    return model
