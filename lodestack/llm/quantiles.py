"""Exact percentiles per group of any number of values, from states that can be put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.ranking import positions
from lodestack.session import cut


def quantile_state(df: DataFrame, groups: list[str], value: str, resolution: float | None = None) -> DataFrame:
    """(groups, value, ``n``): how often each value occurs in each group. Nulls and NaN are no values.

    This is the state that is kept per release or day. With ``resolution`` values are rounded to multiples of
    it, so a state has at most range / resolution rows per group and a percentile errs by at most half of it;
    without, percentiles are exact. The counts are made before anything is shuffled.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*groups, (F.round(v / resolution) * resolution if resolution else v).alias(value))
    return rows.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state for all, of separate tables or of one in which states lie under one another; the order does not matter."""
    whole = states[0]
    for state in states[1:]:
        whole = whole.unionByName(state)
    keys = [c for c in whole.columns if c != "n"]
    return whole.groupBy(*keys).agg(F.sum("n").alias("n"))


def quantiles(state: DataFrame, groups: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(groups, ``probability``, ``n``, ``quantile``): exact percentiles, interpolated between neighbours.

    The state is range-partitioned and sorted by group and value over all tasks; counts of each partition give
    every value its place in its group; the places that a percentile lies between are picked out, and two neighbouring
    order statistics are interpolated. Ties are one row with a count, so a value may occur any number of
    times. Null groups are groups; a group without values has no rows; a single value is every percentile.
    """
    keys = [f"__g{i}" for i in range(len(groups))]
    state = cut(state)
    rows = state.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(value).cast("double").alias("__v"), F.col("n").alias("__n"))
    placed = positions(rows, keys, ["__v"], weight="__n")
    totals = rows.groupBy(*keys).agg(F.sum("__n").alias("__total")).select(*[F.col(k).alias(f"__t{k}") for k in keys], "__total")
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__t{k}"))
    placed = placed.join(totals, on)
    at = F.array(*[F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("__total") - 1)).alias("at")) for p in probabilities])
    first, end = F.col("__start"), F.col("__start") + F.col("__n")
    covers = lambda place: (place >= first) & (place < end)
    hit = F.filter(at, lambda t: covers(F.floor(t["at"])) | covers(F.ceil(t["at"])))
    near = placed.select(*keys, "__total", "__v", F.explode(hit).alias("__t"))
    out = near.groupBy(*keys, F.col("__t.p").alias("probability")).agg(
        F.max("__total").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.max("__t.at").alias("__at")
    )
    part = F.col("__at") - F.floor("__at")
    return out.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], "probability", "n", (F.col("__low") + (F.col("__high") - F.col("__low")) * part).alias("quantile"))


def peer_ratios(facts: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Ratios in the payment file with the hospital's peer group, each row that is repeated in full once.

    The hospital's last ingested row of a fiscal year gives its group; rows without a group or ratio are left out.
    """
    paid = facts.where(F.col("in_payment_file") & F.col("excess_readmission_ratio").isNotNull()).distinct()
    paid = paid.select("fiscal_year", "condition", "facility_id", "excess_readmission_ratio", "peer_group_median_err")
    keys = ["facility_id", "fiscal_year"]
    last = adjustments.where(F.col("facility_id").isNotNull()).groupBy(*keys).agg(F.max(F.struct("ingested_at", "peer_group")).alias("__last"))
    groups = last.select(*keys, F.col("__last.peer_group").cast("bigint").alias("peer_group")).where(F.col("peer_group").isNotNull())
    return paid.join(groups, keys)


PEERS = ["fiscal_year", "condition", "peer_group"]


def median_differences(ratios: DataFrame, tolerance: float) -> DataFrame:
    """Groups whose published median differs from the true one by more than ``tolerance``. The published median of a
    group is the value that most of its rows have."""
    medians = quantiles(quantile_state(ratios, PEERS, "excess_readmission_ratio"), PEERS, "excess_readmission_ratio", [0.5])
    said = quantile_state(ratios, PEERS, "peer_group_median_err").groupBy(*PEERS).agg(F.max_by("peer_group_median_err", F.struct("n", "peer_group_median_err")).alias("published"))
    both = medians.join(said, PEERS)
    return both.where(F.abs(F.col("quantile") - F.col("published")) > tolerance).select(*PEERS, F.col("quantile").alias("median"), "published", "n")
