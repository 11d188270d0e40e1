"""A parameter search that can be broken off: a store of finished trials, and proposals that depend on it alone.

A trial's proposal is made from its number, the seed and the trials before it, so a search that goes on with a store
makes the same trials as one that was never interrupted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.sources.tables import is_built

# Trials drawn at random before densities say anything, the share of trials that count as good, and draws to choose from.
FIRST_RANDOM = 8
GOOD_SHARE = 0.25
CANDIDATES = 24
TRIALS = "trial bigint, params string, log_loss double, macro_f1 double, folds string"


class SearchSettingsError(ValueError):
    """Stored trials were made with other settings, so they cannot be compared."""


@dataclass(frozen=True)
class Range:
    """Numbers from ``low`` to ``high``, whole ones or evenly spread by their logarithm if asked for."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def place(self, value: float) -> float:
        low, high, value = (math.log(v) if self.log else v for v in (self.low, self.high, value))
        return (value - low) / (high - low) if high > low else 0.5

    def value(self, place: float) -> float:
        low, high = (math.log(v) if self.log else v for v in (self.low, self.high))
        found = low + min(max(place, 0.0), 1.0) * (high - low)
        found = min(max(math.exp(found) if self.log else found, self.low), self.high)
        return int(round(found)) if self.whole else float(found)


Space = dict[str, "Range | Sequence"]


def ranked(trials: Sequence[dict]) -> list[dict]:
    """Trials from best to worst: by the sum of their places by loss and by F1, then by number."""
    by_loss = {t["trial"]: i for i, t in enumerate(sorted(trials, key=lambda t: (t["log_loss"], t["trial"])))}
    by_f1 = {t["trial"]: i for i, t in enumerate(sorted(trials, key=lambda t: (-t["macro_f1"], t["trial"])))}
    return sorted(trials, key=lambda t: (by_loss[t["trial"]] + by_f1[t["trial"]], t["trial"]))


def _log_density(place: float, places: list[float], width: float) -> float:
    """Log of a mixture of one bell per place and an even spread over the range."""
    bells = [math.exp(-0.5 * ((place - p) / width) ** 2) / (width * math.sqrt(2 * math.pi)) for p in places]
    return math.log((1 + sum(bells)) / (1 + len(places)))


def propose(space: Space, done: Sequence[dict], trial: int, seed: int = 0) -> dict:
    """Parameters of a trial: random at first, then those that good trials favour over the others.

    Each parameter is drawn near a good trial's; of several draws the one is taken whose density among good trials,
    divided by that among the others, is largest.
    """
    rng = np.random.default_rng([seed, trial])
    done = [t for t in done if t["trial"] < trial]
    best = ranked(done)
    n_good = max(1, math.ceil(GOOD_SHARE * len(best)))
    good, rest = best[:n_good], best[n_good:]
    found = {}
    for name, domain in space.items():
        random = len(done) < FIRST_RANDOM
        if isinstance(domain, Range):
            if random:
                found[name] = domain.value(rng.random())
                continue
            near, far = ([domain.place(t["params"][name]) for t in part] for part in (good, rest))
            width = max(0.05, 1 / (1 + len(near)))
            draws = [near[rng.integers(len(near))] + width * rng.normal() if rng.random() > 0.1 else rng.random() for _ in range(CANDIDATES)]
            draws = [min(max(d, 0.0), 1.0) for d in draws]
            ratio = [_log_density(d, near, width) - _log_density(d, far, width) for d in draws]
            found[name] = domain.value(draws[int(np.argmax(ratio))])
        else:
            values = list(domain)
            if random:
                found[name] = values[int(rng.integers(len(values)))]
                continue
            counts = [[1 + sum(t["params"][name] == v for t in part) for v in values] for part in (good, rest)]
            share = np.array(counts[0]) / sum(counts[0])
            draws = rng.choice(len(values), size=CANDIDATES, p=share)
            odds = share / (np.array(counts[1]) / sum(counts[1]))
            found[name] = values[int(max(draws, key=lambda i: (odds[i], -i)))]
    return found


class TrialStore:
    """Finished trials in a folder, one small file each, next to the settings they were made with."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path = spark, path
        line = json.dumps(settings, sort_keys=True, default=str)
        if is_built(spark, f"{path}/settings"):
            kept = spark.read.text(f"{path}/settings").first()["value"]
            if kept != line:
                raise SearchSettingsError(f"the stored trials were made with {kept}, these settings are {line}")
        else:
            spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    def table(self) -> DataFrame:
        """All finished trials, each once."""
        if not is_built(self.spark, f"{self.path}/trials"):
            return self.spark.createDataFrame([], TRIALS)
        return self.spark.read.schema(TRIALS).json(f"{self.path}/trials").dropDuplicates(["trial"])

    def trials(self) -> list[dict]:
        rows = [r.asDict() for r in self.table().orderBy("trial").collect()]
        return [{**r, "params": json.loads(r["params"])} for r in rows]

    def add(self, trial: int, params: dict, scores: Sequence[dict]) -> None:
        """Store a trial with the scores of its folds; only whole trials are stored."""
        loss, f1 = (sum(s[c] for s in scores) / len(scores) for c in ("log_loss", "macro_f1"))
        row = (trial, json.dumps(params, sort_keys=True), loss, f1, json.dumps(list(scores), sort_keys=True))
        self.spark.createDataFrame([row], TRIALS).coalesce(1).write.mode("append").json(f"{self.path}/trials")


def fold_rows(dataset: DataFrame, folds: Sequence, fold: int, days_gap: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of a fold, as date ranges of the stored dataset: nothing is copied."""
    bounds = next(f for f in folds if f["fold"] == fold)
    start, end = F.lit(bounds["val_start"]), F.lit(bounds["val_end"])
    train = dataset.where(F.col("date") < start - F.make_dt_interval(F.lit(days_gap)))
    return train, dataset.where((F.col("date") >= start) & (F.col("date") <= end))
