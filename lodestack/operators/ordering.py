"""Ranks, percentiles, correlations and areas that need an order over all rows, without a window over them.

Values are first counted (equal values are one row), the counts are sorted over all tasks, and the ranks are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.ranking import positions


def value_places(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, ``n``, ``start``, ``total``): each distinct value of a group, how many rows have it, how many have a
    smaller one, and how many have any. Nulls have no place."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    placed = positions(counts, list(groups), [value], weight="n").withColumnRenamed("__start", "start")
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("total"))
    return _joined(placed, totals, groups)


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which null keys meet."""
    if not keys:
        return a.crossJoin(b)
    c = b.withColumnsRenamed({k: f"__j_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__j_{k}"))
    return a.join(c, on, how).drop(*[f"__j_{k}" for k in keys])


def average_rank() -> Column:
    """The mean rank of equal values, from 1."""
    return F.col("start") + (F.col("n") + 1) / 2


def with_rank(df: DataFrame, groups: Sequence[str], value: str, rank: Column, name: str) -> DataFrame:
    places = value_places(df, groups, value).select(*groups, value, rank.alias(name))
    return _joined(df, places, [*groups, value], "left")


def percent_ranked(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the mean rank of its value as a share of the group."""
    return with_rank(df, groups, value, average_rank() / F.col("total"), name)


def group_quantiles(df: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """(groups, ``q0``, ``q1``, ...): exact, interpolated between neighbouring values."""
    places = value_places(df, groups, value)
    out = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("total") - 1)
        has = lambda k: (k >= F.col("start")) & (k < F.col("start") + F.col("n"))
        low, high = F.max(F.when(has(F.floor(at)), F.col(value))), F.max(F.when(has(F.ceil(at)), F.col(value)))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(f"q{i}"))
    return places.groupBy(*groups).agg(*out)


def top_share_flag(df: DataFrame, groups: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    """``df`` with whether the value reaches the group's quantile ``p``; null for a null value."""
    edges = group_quantiles(df, groups, value, [p])
    return _joined(df, edges, groups, "left").withColumn(name, F.col(value) >= F.col("q0")).drop("q0")


def bucketed(df: DataFrame, groups: Sequence[str], value: str, buckets: int, name: str) -> DataFrame:
    """``df`` with the number, from 1, of the quantile bucket of its value; an edge belongs to the bucket below."""
    edges = group_quantiles(df, groups, value, [i / buckets for i in range(1, buckets)])
    above = sum((F.col(value) > F.col(f"q{i}")).cast("int") for i in range(buckets - 1)) + 1
    return _joined(df, edges, groups, "left").withColumn(name, above).drop(*[f"q{i}" for i in range(buckets - 1)])


def spearman(df: DataFrame, groups: Sequence[str], a: str, b: str) -> DataFrame:
    """(groups, ``rho``, ``n``) over rows that have both values; null where one is constant."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = with_rank(with_rank(rows, groups, a, average_rank(), "__ra"), groups, b, average_rank(), "__rb")
    rho = F.try_divide(F.covar_pop("__ra", "__rb"), F.stddev_pop("__ra") * F.stddev_pop("__rb"))
    varies = (F.min("__ra") < F.max("__ra")) & (F.min("__rb") < F.max("__rb"))
    return ranked.groupBy(*groups).agg(F.when(varies, rho).alias("rho"), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    """(groups, ``auc``, ``n``): the chance that a positive row is scored above a negative one, ties half; null with one class.
    Made of counts of distinct scores by class, so equal scores cost one row."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = rows.groupBy(*groups, score).agg(F.sum(F.col(label).cast("int")).cast("bigint").alias("pos"), F.count(F.lit(1)).alias("n"))
    placed = positions(counts, list(groups), [score], weight="n")
    total = placed.groupBy(*groups).agg(
        F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(F.col("pos") * (F.col("__start") + (F.col("n") + 1) / 2)).alias("ranks")
    )
    negatives = F.col("n") - F.col("p")
    area = F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * negatives)
    return total.select(*groups, area.alias("auc"), "n")
