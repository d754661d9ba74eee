"""Full history of changing attributes, with the period in which each version was valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.ranking import last_row
from lodestack.operators.snapshots import snapshot_index


def change_events(df: DataFrame, snapshot: str, key: str, attributes: list[str], order: list[Column | str]) -> DataFrame:
    """(key, ``__i``, ``__at``, ``__kind``, attributes) for every key ``inserted``, ``changed`` or ``deleted``
    between a snapshot and the next.

    Every snapshot is compared with its successor in one null-safe full outer join of the table with itself,
    moved on by one place. A missing attribute keeps the key's value before (filled by key, in order).
    """
    held = last_row(df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()), [key, snapshot], attributes, order)
    rows = held.join(snapshot_index(df, snapshot), snapshot)
    w = Window.partitionBy(key).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    now = rows.select(key, "__i", F.col(snapshot).alias("__label"), "__n", "__next", *[F.last(a, True).over(w).alias(a) for a in attributes])
    then = now.where(F.col("__i") < F.col("__n")).select(
        F.col(key).alias("__key"), (F.col("__i") + 1).alias("__j"), F.col("__next").alias("__then"), F.struct(*attributes).alias("__old"), F.lit(True).alias("__was")
    )
    now = now.select(key, "__i", "__label", *attributes, F.struct(*attributes).alias("__new"), F.lit(True).alias("__is"))
    both = now.join(then, (F.col(key) == F.col("__key")) & (F.col("__i") == F.col("__j")), "full_outer")
    kind = (
        F.when(F.col("__was").isNull(), "inserted")
        .when(F.col("__is").isNull(), "deleted")
        .when(~F.col("__new").eqNullSafe(F.col("__old")), "changed")
    )
    return both.select(
        F.coalesce(key, "__key").alias(key),
        F.coalesce("__i", "__j").alias("__i"),
        F.coalesce("__label", "__then").alias("__at"),
        kind.alias("__kind"),
        *attributes,
    ).where(F.col("__kind").isNotNull())


def validity_history(df: DataFrame, snapshot: str, key: str, attributes: list[str], order: list[Column | str]) -> DataFrame:
    """(key, ``valid_from``, ``valid_to``, attributes): one row per version, from periodic full snapshots.

    A version is a run of consecutive snapshots with the same attributes. ``valid_to`` is the first later
    snapshot in which the key differs or is missing, null if there is none; a return after absence begins a
    version. Of several rows of a key in a snapshot the last by ``order`` holds. Rows with a null key or
    snapshot are left out, an empty table gives no rows, other columns are ignored.
    """
    events = change_events(df, snapshot, key, attributes, order)
    end = F.lead("__at").over(Window.partitionBy(key).orderBy("__i"))
    return events.withColumn("__end", end).where(F.col("__kind") != "deleted").select(
        key, F.col("__at").alias("valid_from"), F.col("__end").alias("valid_to"), *attributes
    )
