"""How well a score ranks hospitals within a year, and how sure that is."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.ordering import auc, spearman

RANKED = ("auc_top_quarter", "auc_penalized", "spearman", "mae_pct")


def year_metrics(df: DataFrame, score: str, target: str = "payment_reduction_pct", year: str = "fiscal_year") -> DataFrame:
    """One row a year: areas for both labels, rank correlation, mean absolute error and means. All by distributed counts."""
    means = df.groupBy(year).agg(
        F.avg(F.abs(F.col(target) - F.col(score))).alias("mae_pct"), F.avg(target).alias("mean_actual_pct"), F.avg(score).alias("mean_predicted_pct"), F.count(F.lit(1)).alias("hospitals")
    )
    top = auc(df, [year], "is_top_quarter_penalty", score).select(year, F.col("auc").alias("auc_top_quarter"))
    penalized = auc(df, [year], "is_penalized", score).select(year, F.col("auc").alias("auc_penalized"))
    rho = spearman(df, [year], target, score).select(year, F.col("rho").alias("spearman"))
    return means.join(top, year, "left").join(penalized, year, "left").join(rho, year, "left")


def within_year_metrics(df: DataFrame, score: str, target: str = "payment_reduction_pct", year: str = "fiscal_year") -> dict[str, float]:
    """Each year's metrics averaged by its number of hospitals, years without a value left out."""
    years = year_metrics(df, score, target, year)
    weighted = [F.try_divide(F.sum(F.col(m) * F.col("hospitals")), F.sum(F.when(F.col(m).isNotNull(), F.col("hospitals")))).alias(m) for m in RANKED]
    row = years.agg(*weighted).first()
    return {m: math.nan if row[m] is None else float(row[m]) for m in RANKED}


def _ranks(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank().to_numpy()


def auc_of(labels: np.ndarray, score: np.ndarray) -> float:
    p = int(labels.sum())
    n = len(labels) - p
    return math.nan if not p or not n else float((_ranks(score)[labels.astype(bool)].sum() - p * (p + 1) / 2) / (p * n))


def spearman_of(a: np.ndarray, b: np.ndarray) -> float:
    x, y = _ranks(a), _ranks(b)
    return math.nan if x.std() == 0 or y.std() == 0 else float(np.corrcoef(x, y)[0, 1])


def _figure(metric: str, rows: pd.DataFrame, score: str) -> float:
    if metric == "spearman":
        return spearman_of(rows["target"].to_numpy(), rows[score].to_numpy())
    return auc_of(rows["label"].to_numpy(), rows[score].to_numpy())


#: Most rows of one year that are resampled; they go to every task that draws.
MOST_ROWS = 1_000_000


def bootstrap(df: DataFrame, scores: Sequence[str], metric: str, n: int = 1000, seed: int = 0, target: str = "payment_reduction_pct", year: str = "fiscal_year") -> DataFrame:
    """(``draw``, one column per score): the metric on hospitals drawn with replacement, the same for all scores. Draws are spread
    over tasks, each with a generator of its own seed; one year's rows, which are few, go to each task."""
    label = "is_penalized" if metric == "auc_penalized" else "is_top_quarter_penalty"
    if df.select(year).distinct().count() != 1:
        raise ValueError("one year at a time is resampled")
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows in a year")
    rows = df.select(F.col(target).alias("target"), F.col(label).cast("int").alias("label"), *scores).orderBy(*scores, "target").toPandas()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(rows)
    names = list(scores)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                picked = shared.value.iloc[np.random.default_rng([seed, int(i)]).integers(0, len(shared.value), len(shared.value))]
                out.append((int(i), *(_figure(metric, picked, s) for s in names)))
            yield pd.DataFrame(out, columns=["draw", *names])

    return spark.range(n).mapInPandas(draw, "draw bigint, " + ", ".join(f"`{s}` double" for s in names))


def bootstrap_interval(df: DataFrame, score: str, metric: str, n: int = 1000, seed: int = 0, level: float = 0.95) -> tuple[float, float]:
    draws = bootstrap(df, [score], metric, n, seed).where(~F.isnan(score))
    low, high = (1 - level) / 2, (1 + level) / 2
    return tuple(draws.agg(F.percentile(score, F.array(F.lit(low), F.lit(high))).alias("q")).first()["q"])


def bootstrap_difference(df: DataFrame, score: str, reference: str, metric: str, n: int = 1000, seed: int = 0, level: float = 0.95) -> dict:
    """How much a score is better than a reference on the same draws, with the share of draws in which it is."""
    draws = bootstrap(df, [score, reference], metric, n, seed).withColumn("d", F.col(score) - F.col(reference)).where(~F.isnan("d"))
    q = F.percentile("d", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q")
    row = draws.agg(q, F.avg((F.col("d") > 0).cast("double")).alias("better"), F.avg("d").alias("mean")).first()
    return {"difference": row["mean"], "interval": tuple(row["q"]), "share_better": row["better"]}
