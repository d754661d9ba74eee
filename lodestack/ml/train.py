"""Grouped cross-validation, tuning, the choice of a family, and the report."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.export import rounded
from lodestack.ml.metrics import bootstrap_interval, within_year_metrics
from lodestack.ml.models import SCORE, Fitted, earlier_value, fit_additive, fit_ridge, fit_trees, training_mean
from lodestack.ml.roles import honest_split

Fit = Callable[..., Fitted]

#: Families from the simplest on, with the settings that are tried. Depths 3, 4 and 5 stand for at most 7, 15 and 31 leaves.
FAMILIES: dict[str, tuple[Fit, list[dict]]] = {
    "ridge": (fit_ridge, [{"alpha": a} for a in (0.1, 1.0, 10.0, 100.0, 300.0, 1000.0, 10000.0)]),
    "additive": (fit_additive, [{}]),
    "trees": (fit_trees, [{"depth": d, "least": n, "trees": t, "step": 0.02} for d in (3, 4, 5) for n in (50, 200) for t in (300, 600)]),
}

#: A simpler family is chosen if it is at most so much worse.
NEAR_ENOUGH = 0.01


def grouped_folds(df: DataFrame, k: int = 5, group: str = "facility_id", seed: int = 0) -> DataFrame:
    """All rows of a group in one fold."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), group), F.lit(k)).cast("int"))


def cross_validated(fit: Fit, train: DataFrame, features: Sequence[str], target: str, params: Mapping, k: int = 5, metric: str = "auc_top_quarter") -> float:
    folded, found = grouped_folds(train, k), []
    for i in range(k):
        model = fit(folded.where(F.col("fold") != i), features, target, **params)
        found.append(within_year_metrics(model.score(folded.where(F.col("fold") == i)), SCORE)[metric])
    known = [x for x in found if not math.isnan(x)]
    return sum(known) / len(known) if known else math.nan


def tune(family: str, train: DataFrame, features: Sequence[str], target: str, k: int = 5, grid: Sequence[Mapping] | None = None) -> tuple[dict, float]:
    fit, settings = FAMILIES[family]
    tried = [(dict(p), cross_validated(fit, train, features, target, p, k)) for p in (settings if grid is None else grid)]
    return max(tried, key=lambda x: -math.inf if math.isnan(x[1]) else x[1])


def choose(found: Mapping[str, float], order: Sequence[str] = tuple(FAMILIES)) -> str:
    """The simplest family within ``NEAR_ENOUGH`` of the best."""
    best = max(found.values())
    return next(f for f in order if f in found and found[f] >= best - NEAR_ENOUGH - 1e-12)


def naive_splits(df: DataFrame, seed: int = 0) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What looks better than it is: rows dealt at random, and training years that share patients with the test year."""
    mixed = F.pmod(F.xxhash64(F.lit(seed), "facility_id", "fiscal_year"), F.lit(100)) < 20
    known = df.where(F.col("split") != "unused")
    return {"random": (known.where(~mixed), known.where(mixed)), "overlap": (df.where(F.col("split") != "test"), df.where(F.col("split") == "test"))}


def run(df: DataFrame, features: Sequence[str], target: str, families: Sequence[str] = tuple(FAMILIES), k: int = 5, draws: int = 1000, grids: Mapping[str, Sequence[Mapping]] | None = None) -> dict:
    """Baselines and families, tuned on training years and scored on the test year, as one report."""
    train, test = honest_split(df)
    fill = F.lit(train.agg(F.avg(target)).first()[0])
    scored = {"training_mean": training_mean(train, test, target), "own_earlier": earlier_value(df, test, 3, target, fill)}
    report: dict = {"models": {}}
    found: dict[str, float] = {}
    for family in families:
        params, auc = tune(family, train, features, target, k, (grids or {}).get(family))
        found[family] = auc
        scored[family] = FAMILIES[family][0](train, features, target, **params).score(test)
        report["models"][family] = {"params": params, "cv_auc": auc}
    for name, rows in scored.items():
        entry = report["models"].setdefault(name, {})
        entry["test"] = within_year_metrics(rows, SCORE)
        if name != "training_mean":
            entry["auc_interval"] = list(bootstrap_interval(rows, SCORE, "auc_top_quarter", draws))
    report["chosen"] = choose(found)
    report["rows"] = {"train": train.count(), "test": test.count()}
    return report


def write_report(report: Mapping, folder: str | Path) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "metrics.json").write_text(json.dumps(rounded(dict(report)), indent=1))


def save_models(models: Mapping[str, Fitted], folder: str) -> None:
    for name, model in models.items():
        model.pipeline.write().overwrite().save(f"{folder}/{name}")


def lift(df: DataFrame, flag: str, target: str, label: str) -> DataFrame:
    """Flagged and other rows: how many, their mean, and the share that has the label."""
    return df.groupBy(flag).agg(F.count(F.lit(1)).alias("hospitals"), F.avg(target).alias("mean"), F.avg(F.col(label).cast("double")).alias("share"))
