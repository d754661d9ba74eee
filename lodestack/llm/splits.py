"""Train, validation and test splits that keep connected records together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.ranking import positions
from lodestack.session import cut

#: The step of systematic dealing, the golden ratio's fraction: any run of positions is spread evenly over [0, 1).
STEP = (math.sqrt(5) - 1) / 2

#: Rounds after which contraction must have ended; each round at least halves the components that have edges.
MOST_ROUNDS = 64


def _stars(hooks: DataFrame) -> DataFrame:
    """(``c``, ``p``) with every ``p`` a root, from hooks of which each leads to another component.

    Each component hooks on over its smallest edge, so the only circles are two components that chose the same
    edge; of these the smaller becomes the root. Pointer jumping then halves the way to the root each time.
    """
    back = hooks.select(F.col("c").alias("__c"), F.col("d").alias("__d"))
    joined = hooks.join(back, (F.col("d") == F.col("__c")) & (F.col("c") == F.col("__d")), "left")
    up = cut(joined.select("c", F.when(F.col("__c").isNotNull() & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("p")))
    for _ in range(MOST_ROUNDS):
        far = up.select(F.col("c").alias("__c"), F.col("p").alias("__p"))
        up = cut(up.join(far, F.col("p") == F.col("__c"), "left").select("c", F.coalesce("__p", "p").alias("p"), (F.col("__p") != F.col("p")).alias("__moved")))
        if not up.where("__moved").limit(1).count():
            return up.select("c", "p")
        up = up.select("c", "p")
    raise RuntimeError(f"roots were not reached in {MOST_ROUNDS} rounds")


def spanning_forest(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """The forest (``round``, ``a``, ``b``) and the labels (``node``, ``root``), by contraction as Borůvka's.

    In each round every component takes its smallest edge (edges are ordered by their ends, so all differ), the chosen
    edges join the forest, components that hang together become one, and edges within it and parallel ones go.
    ``root`` is the smallest node of its component. Every round is written to the checkpoint folder.

    Rows with a null or blank end and self-references are no edges; direction and repetition do not matter. Nodes
    without an edge have no row.
    """
    x, y = F.nullif(F.trim(a), F.lit("")), F.nullif(F.trim(b), F.lit(""))
    pairs = edges.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (x.isNotNull() & y.isNotNull()).alias("__both")).where("__both")
    live = cut(pairs.where(F.col("a") < F.col("b")).select("a", "b").distinct().select(F.col("a").alias("ca"), F.col("b").alias("cb"), "a", "b"))
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    labels = nodes.select("node", F.col("node").alias("c"))
    forest = None
    for round_ in range(MOST_ROUNDS):
        if not live.limit(1).count():
            break
        ends = live.select(F.col("ca").alias("c"), F.col("cb").alias("d"), "a", "b").union(live.select("cb", "ca", "a", "b"))
        chosen = cut(ends.groupBy("c").agg(F.min(F.struct("a", "b", "d")).alias("e")).select("c", "e.*"))
        taken = chosen.select(F.lit(round_).alias("round"), "a", "b").distinct()
        forest = taken if forest is None else forest.unionByName(taken)
        up = _stars(chosen.select("c", "d"))
        root = lambda side: up.select(F.col("c").alias(side), F.col("p").alias(f"__{side}"))  # noqa: B023, E731
        live = live.join(root("ca"), "ca", "left").join(root("cb"), "cb", "left")
        live = live.select(F.coalesce("__ca", "ca").alias("ca"), F.coalesce("__cb", "cb").alias("cb"), "a", "b").where(F.col("ca") != F.col("cb"))
        low, high = F.least("ca", "cb"), F.greatest("ca", "cb")
        live = cut(live.groupBy(low.alias("l"), high.alias("h")).agg(F.min(F.struct("a", "b")).alias("e")).select(F.col("l").alias("ca"), F.col("h").alias("cb"), "e.a", "e.b"))
        labels = cut(labels.join(root("c"), "c", "left").select("node", F.coalesce("__c", "c").alias("c")))
    else:
        raise RuntimeError(f"contraction did not end in {MOST_ROUNDS} rounds")
    smallest = labels.groupBy("c").agg(F.min("node").alias("root"))
    labels = labels.join(smallest, "c").select("node", "root")
    if forest is None:
        forest = live.select(F.lit(0).alias("round"), "a", "b")
    return cut(forest), cut(labels)


def grouped_rows(rows: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """``rows`` with ``group_id``: the root of the row's node, or the node itself if it is connected to none."""
    names = labels.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    joined = rows.join(names, F.trim(F.col(node)) == F.col("__node"), "left")
    return joined.withColumn("group_id", F.coalesce("__root", F.trim(F.col(node)))).drop("__node", "__root")


def leaking_groups(rows: DataFrame, split: str) -> DataFrame:
    """Groups whose rows lie in more than one split; case and blanks don't count, nulls and blank splits are none."""
    name = F.nullif(F.lower(F.trim(split)), F.lit(""))
    found = rows.groupBy("group_id").agg(F.min(name).alias("__low"), F.max(name).alias("__high"))
    return found.where(F.col("__low") != F.col("__high")).select("group_id")


def deal(groups: DataFrame, size: str, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """``groups`` (one row per ``group_id``) with a ``split``, in the given shares.

    Groups are stratified by the power of two of their size; within a band they are put in a pseudo-random order and
    dealt systematically: place r goes where the fraction of (r + 1/2) times the golden ratio falls. So each
    band, hence the rows, is split in proportion, and the largest groups, alone in their band, go to the split that
    begins at 0, the first of ``shares``. The same groups give the same splits.
    """
    banded = groups.withColumns({"__band": F.floor(F.log2(F.greatest(F.col(size), F.lit(1)))).cast("int"), "__mix": F.xxhash64(F.lit(seed), "group_id")})
    placed = positions(banded, ["__band"], ["__mix", "group_id"])
    u = ((F.col("__start") + 0.5) * STEP) % 1.0
    total, edge, split = sum(shares.values()), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name] / total
        split = F.when(u < edge, name) if split is None else split.when(u < edge, name)
    last: Column = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return placed.select(*groups.columns, last.alias("split"))


def assign_splits(rows: DataFrame, edges: DataFrame, node: str, a: str, b: str, shares: dict[str, float]) -> DataFrame:
    """``rows`` without an own ``split`` column, with ``group_id`` and ``split``; a row without a node is a null group
    and goes to the first split."""
    _, labels = spanning_forest(edges, a, b)
    known = cut(grouped_rows(rows.drop("split", "group_id"), labels, node))
    sizes = known.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.count(F.lit(1)).alias("rows"))
    dealt = deal(sizes, "rows", shares).select(F.col("group_id").alias("__g"), "split")
    return known.join(dealt, F.col("group_id") == F.col("__g"), "left").drop("__g").withColumn("split", F.coalesce("split", F.lit(next(iter(shares)))))
