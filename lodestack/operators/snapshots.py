"""What changed between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.ranking import content_hash, last_hash


def snapshot_index(df: DataFrame, snapshot: str) -> DataFrame:
    """One row per snapshot: its label, its place from 1 (``__i``), the number of snapshots (``__n``) and the
    next label. The window has no partition, over as many rows as there were deliveries."""
    w = Window.orderBy(snapshot)
    labels = df.where(F.col(snapshot).isNotNull()).select(snapshot).distinct()
    return labels.select(
        snapshot,
        F.row_number().over(w).alias("__i"),
        F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__n"),
        F.lead(snapshot).over(w).alias("__next"),
    )


def snapshot_changes(df: DataFrame, snapshot: str, keys: list[str], values: list[str], order: list[Column | str]) -> DataFrame:
    """(snapshot, keys, ``change_kind``): each key that was ``added``, ``removed`` or ``changed`` since the
    snapshot before.

    Each key's rows are put in order by the place of their snapshot: a lagged hash of ``values`` that
    differs is a change, and a gap between places is a removal after the one and an addition at the other.
    So any number of snapshots takes one shuffle by key, on keys far finer than any hot source or state.

    Of several rows of a key in a snapshot the last by ``order`` holds. Null values equal null, and nothing
    else: the hash takes in which columns are null. Rows with a null snapshot or a null in a key column
    cannot be placed and are left out; the first snapshot has no changes, and an empty table or a single
    snapshot gives no rows. Other columns are ignored. Only hashes of 63 bits are shuffled; two different
    contents of one key in neighbouring snapshots look equal with a chance of one in 2**63.
    """
    known = F.lit(True)
    for c in [snapshot, *keys]:
        known &= F.col(c).isNotNull()
    held = last_hash(df.where(known), [snapshot, *keys], content_hash(values), order)
    rows = held.join(F.broadcast(snapshot_index(df, snapshot)), snapshot)
    w = Window.partitionBy(*keys).orderBy("__i")
    before, after = F.lag("__i").over(w), F.lead("__i").over(w)
    rows = rows.withColumns({"__before": before, "__after": after, "__was": F.lag("__hash").over(w)})
    i = F.col("__i")
    event = lambda label, kind: F.struct(label.alias("label"), F.lit(kind).alias("kind"))
    events = F.array(
        F.when((i > 1) & F.coalesce(F.col("__before") < i - 1, F.lit(True)), event(F.col(snapshot), "added")),
        F.when((F.col("__before") == i - 1) & (F.col("__was") != F.col("__hash")), event(F.col(snapshot), "changed")),
        F.when((i < F.col("__n")) & F.coalesce(F.col("__after") > i + 1, F.lit(True)), event(F.col("__next"), "removed")),
    )
    found = rows.select(*keys, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("__event"))
    return found.select(F.col("__event.label").alias(snapshot), *keys, F.col("__event.kind").alias("change_kind"))
