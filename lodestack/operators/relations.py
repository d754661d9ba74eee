"""Relational transforms that versioned, published tables need: releases, periods, as-of joins, ladders, reshaping.

Every function takes and returns DataFrames (or Columns) and leaves the physical plan to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.session import cut

#: Most windows that ``asof_window`` holds in one row; they are periods of publication, of which there are few.
MOST_WINDOWS = 100_000


# Releases and periods


def latest_release(df: DataFrame, release: str) -> DataFrame:
    """The rows of the largest release label. The label is a scalar subquery, so on a partition column it prunes files."""
    return df.where(F.col(release) == df.select(F.max(release)).scalar())


def latest_snapshot_per_period(df: DataFrame, release: str, start: Column | str, end: Column | str) -> DataFrame:
    """The rows of the last release of each period, whole, with ``_period_first_release`` and ``_period_snapshots``.

    Releases by periods are few, however many rows they have: they are found first and joined back.
    """
    keyed = df.withColumns({"__s": F.col(start) if isinstance(start, str) else start, "__e": F.col(end) if isinstance(end, str) else end})
    seen = keyed.select(release, "__s", "__e").distinct()
    kept = seen.groupBy("__s", "__e").agg(F.max(release).alias("__last"), F.min(release).alias("_period_first_release"), F.count(F.lit(1)).alias("_period_snapshots"))
    kept = kept.withColumnsRenamed({"__s": "__ks", "__e": "__ke"})
    on = (F.col(release) == F.col("__last")) & F.col("__s").eqNullSafe(F.col("__ks")) & F.col("__e").eqNullSafe(F.col("__ke"))
    return keyed.join(kept, on).drop("__s", "__e", "__ks", "__ke", "__last")


def without_footers(df: DataFrame, key: str, words: Iterable[str]) -> DataFrame:
    """Rows whose key is neither blank nor one of ``words`` (case and blanks aside)."""
    text = F.lower(F.trim(key))
    return df.where(text.isNotNull() & (text != "") & ~text.isin(*[w.lower() for w in words]))


def union_releases(frames: Sequence[DataFrame]) -> DataFrame:
    """Releases with different columns under one another, by name; a column that a release lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def either(df: DataFrame, *names: str) -> Column:
    """The first non-null of columns that carry the same thing under names of different years; null if none exists."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


# Choosing rows


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key (row_number; Spark limits the groups before the shuffle)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def rows_at_max(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows with the largest value of their key, ties kept; null keys are keys, rows with a null value go. The largest values are
    aggregated before they are shuffled and joined back, so a hot key is not put into one task."""
    best = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max(value).alias("__max"))
    on = F.col(value) == F.col("__max")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(best, on, "left_semi")


def latest_flag(df: DataFrame, value: str, name: str) -> DataFrame:
    """Whether a row has the largest value of the whole table: a one-row aggregate joined, no window over everything."""
    return df.crossJoin(F.broadcast(df.agg(F.max(value).alias("__max")))).withColumn(name, F.col(value) == F.col("__max")).drop("__max")


def ladder(rungs: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rung whose condition is true."""
    out = F.when(*rungs[0])
    for condition, name in rungs[1:]:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


def differs(a: Column, b: Column) -> Column:
    """Three-valued: null where there is nothing to compare."""
    return F.when(a.isNotNull() & b.isNotNull(), a != b)


# Joins


def outer_sources(left: DataFrame, right: DataFrame, keys: Sequence[str], in_left: str, in_right: str) -> DataFrame:
    """Full outer join of two sources on their keys, with flags for the sources a row comes from."""
    a, b = left.withColumn(in_left, F.lit(True)), right.withColumn(in_right, F.lit(True))
    return a.join(b, list(keys), "full_outer").withColumns({c: F.coalesce(c, F.lit(False)) for c in (in_left, in_right)})


def unique_match(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``left`` with ``value`` of the only row of ``right`` with its keys; null if there is none or more than one."""
    only = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.any_value(value, True).alias(value)).where(F.col("__n") == 1).drop("__n")
    return left.join(only, list(keys), "left")


def shifted(df: DataFrame, key: str, by: int, parse: Callable[[Column], Column], write: Callable[[Column], Column]) -> DataFrame:
    """Rows moved ``by`` periods later, for joining a period with an earlier one. Unlike lag() this is right with gaps."""
    return df.withColumn(key, write(parse(F.col(key)) + F.lit(by)))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that is an error if either side has a key twice."""
    for name, side in (("left", left), ("right", right)):
        if side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise ValueError(f"the {name} side has rows with the same {', '.join(keys)}")
    return left.join(right, list(keys), how)


def asof_window(left: DataFrame, windows: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """``left`` with the window that ends last on or before ``at``; of windows ending together the longest.

    The distinct windows are few (their number is checked): they go to every task as one sorted array, in which the
    last that ends in time is looked up. Null if there is none. Rows of ``left`` are neither moved nor multiplied.
    """
    kinds = windows.select(F.col(start).alias("s"), F.col(end).alias("e")).where(F.col("e").isNotNull()).distinct()
    best = kinds.groupBy("e").agg(F.min("s").alias("s"))
    if best.limit(MOST_WINDOWS + 1).count() > MOST_WINDOWS:
        return _asof_sorted(left, best, at, start, end)
    row = best.agg(F.sort_array(F.collect_list(F.struct("e", "s"))).alias("__w"))
    found = F.try_element_at(F.filter("__w", lambda w: w["e"] <= F.col(at)), F.lit(-1))
    return left.crossJoin(F.broadcast(row)).withColumns({"__f": found}).withColumns({start: F.col("__f.s"), end: F.col("__f.e")}).drop("__w", "__f")


def _asof_sorted(left: DataFrame, windows: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """The same for any number of windows: both sides are range-partitioned by time together and each sorted partition carries the last
    window forward; what a partition begins with is the largest end of all before it, one row a partition."""
    window = F.struct(F.col("e").alias("e"), F.col("s").alias("s"))
    a = left.select(F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(windows.select(window.alias("x")).schema["x"].dataType).alias("__w"))
    b = windows.select(F.col("e").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), window.alias("__w"))
    rows = a.unionByName(b).repartitionByRange(F.col("__t").asc_nulls_first(), F.col("__side"))
    rows = cut(rows.withColumn("__part", F.spark_partition_id()))
    lasts = rows.groupBy("__part").agg(F.max("__w").alias("__w"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    given = lasts.select(F.col("__part").alias("__p"), F.max("__w").over(before).alias("__given"))
    own = Window.partitionBy("__part").orderBy(F.col("__t").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("__last", F.last("__w", True).over(own)).where(F.col("__side") == 1).join(F.broadcast(given), F.col("__part") == F.col("__p"))
    found = F.when(F.col("__t").isNotNull(), F.coalesce("__last", "__given"))
    return both.select("__left.*", found.getField("s").alias(start), found.getField("e").alias(end))


def asof_keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, time: str, values: Sequence[str]) -> DataFrame:
    """``left`` with ``time`` and ``values`` of the last row of ``right`` with its keys at or before ``at``.

    Both sides go under one another and one window by key carries the last right row forward: one shuffle, no
    pairs of rows, however many rows a key has.
    """
    a = left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(F.struct(time, *values).alias("x")).schema["x"].dataType).alias("__right"))
    b = right.select(*keys, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.struct(time, *values).alias("__right"))
    w = Window.partitionBy(*keys).orderBy(F.col("__t").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b.where(F.col("__t").isNotNull())).withColumn("__last", F.last("__right", True).over(w))
    return both.where(F.col("__side") == 1).select("__left.*", *[F.col(f"__last.{c}").alias(c) for c in (time, *values)])


def nearest_snapshot(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, time: str, values: Sequence[str]) -> DataFrame:
    """``left`` with ``time`` and ``values`` of the snapshot of its keys that comes first on or after ``at``, else of the
    last before. One window by key looks both ways; rows are not multiplied. Null if the key has no snapshot."""
    kind = right.select(F.struct(time, *values).alias("x")).schema["x"].dataType
    a = left.select(*keys, F.col(at).alias("__t"), F.lit(0).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(kind).alias("__right"))
    b = right.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.struct(time, *values).alias("__right"))
    order = Window.partitionBy(*keys).orderBy("__t", "__side")
    both = a.unionByName(b).withColumns(
        {
            "__next": F.first("__right", True).over(order.rowsBetween(0, Window.unboundedFollowing)),
            "__prev": F.last("__right", True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    found = both.where(F.col("__side") == 0).withColumn("__f", F.coalesce("__next", "__prev"))
    return found.select("__left.*", *[F.col(f"__f.{c}").alias(c) for c in (time, *values)])


def key_union(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Every key of any of the sources, once."""
    return reduce(DataFrame.union, [f.select(key) for f in frames]).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one relation that the other lacks, with the ``side`` that has them."""
    b = b.select(*a.columns)
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


# Reshaping


def pivoted(key: Column | str, value: Column | str, names: Mapping[str, str], how: Callable[[Column], Column] = F.max) -> list[Column]:
    """One aggregate per wanted key: the value where the key matches. One pass, and no null turns into 0."""
    k, v = (F.col(c) if isinstance(c, str) else c for c in (key, value))
    return [how(F.when(k == wanted, v)).alias(name) for wanted, name in names.items()]


def unpivoted(df: DataFrame, keep: Sequence[str], name: str, blocks: Mapping[str, Mapping[str, Column]], present: str) -> DataFrame:
    """Blocks of columns as rows: one row per block, its name in ``name``. A block whose ``present`` column is null
    does not exist in that row."""
    columns = list(next(iter(blocks.values())))
    made = F.array(*[F.struct(F.lit(block).alias(name), *[block_columns[c].alias(c) for c in columns]) for block, block_columns in blocks.items()])
    return df.select(*keep, F.explode(made).alias("__b")).where(F.col(f"__b.{present}").isNotNull()).select(*keep, "__b.*")


def calendar(spark: SparkSession, first: str, end: str) -> DataFrame:
    """Every day from ``first`` until before ``end``."""
    days = F.sequence(F.to_date(F.lit(first)), F.date_sub(F.to_date(F.lit(end)), 1))
    return spark.range(1).select(F.explode(days).alias("date_day"))


# Summaries


def share_of_total(value: str, keys: Sequence[str]) -> Column:
    return F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*keys)))


def weighted_mean(value: str, weight: str, digits: int = 6) -> Column:
    """The mean of values of at most ``digits`` decimals, weighted by whole numbers; null without weight. The sum is exact, so it
    does not depend on the order in which rows are added."""
    exact = F.col(value).cast(f"decimal(18,{digits})")
    weights = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return F.try_divide(F.sum(exact * F.col(weight).cast("decimal(12,0)")).cast("double"), weights.cast("double"))


def mean_interval(value: str, z: float = 1.96) -> list[Column]:
    """Mean, standard deviation, rows and half the width of the mean's interval."""
    n = F.count(value)
    return [F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), n.alias("n"), (F.stddev_samp(value) * z / F.sqrt(n)).alias("half_width")]


def months_between_starts(first: Column, last: Column) -> Column:
    """Borders of months between two dates."""
    return (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)


def ordered(df: DataFrame, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Sorted by names, ``-name`` descending, nulls last either way; with ``limit`` only the first rows are kept."""
    by = [F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last() for o in order]
    out = df.orderBy(*by) if by else df
    return out.limit(limit) if limit else out


def top_n_members(facts: DataFrame, key: str, measure: Column, n: int) -> DataFrame:
    """The facts of the ``n`` keys with the largest measure; null keys and measures are not ranked."""
    best = facts.where(F.col(key).isNotNull()).groupBy(key).agg(measure.alias("__m")).where(F.col("__m").isNotNull())
    return facts.join(best.orderBy(F.col("__m").desc(), key).limit(n).select(key), key, "left_semi")
