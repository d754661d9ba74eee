"""Positions of rows in a total order, per group, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.session import cut

#: Orders of these types fit into the upper half of a number whose lower half is a hash.
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType, T.IntegralType)
_HALF = 1 << 63


def last_row(df: DataFrame, keys: list[str], keep: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the last by ``order`` (nulls first); rows that tie are told apart by their content,
    so the result does not depend on the order in which rows arrive. Null keys are keys like any other."""
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.xxhash64(*keep), F.struct(*keep))
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*keep), rank).alias("__last"))
        .select(*keys, *[F.col("__last").getField(c).alias(c) for c in keep])
    )


def content_hash(values: list[str]) -> Column:
    """A hash of a row's values that also depends on which of them are null (a null by itself leaves a hash as it was)."""
    return F.xxhash64(*[x for v in values for x in (F.col(v), F.col(v).isNull())])


def last_hash(df: DataFrame, keys: list[str], content: Column, order: list[Column | str]) -> DataFrame:
    """``keys`` and ``__hash``, 63 bits of ``content`` in the last row of each key by ``order`` (nulls first; ties by the hash).

    Ordered by one time, date or integer, time and hash are packed into one decimal, whose maximum is an ordinary hash aggregate
    that combines before the shuffle, however often a key occurs; other orders are compared as structs.
    """
    half = F.shiftright(content, 1)
    kind = df.select(order[0]).schema[0].dataType if len(order) == 1 else None
    if not isinstance(kind, _TIMES):
        rows = df.select(*keys, half.alias("__h"), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], half).alias("__o"))
        return rows.groupBy(*keys).agg(F.max_by("__h", "__o").alias("__hash"))
    at = F.col(order[0]) if isinstance(order[0], str) else order[0]
    if isinstance(kind, T.TimestampType):
        at = F.unix_micros(at)
    elif isinstance(kind, T.TimestampNTZType):
        at = F.unix_micros(at.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        at = F.unix_date(at)
    at = F.coalesce(at.cast("bigint"), F.lit(-_HALF))
    wide = lambda c: c.cast("decimal(19,0)")
    base = F.lit(str(_HALF)).cast("decimal(19,0)")
    packed = (wide(at) * base + wide(half + F.lit(_HALF >> 1))).cast("decimal(38,0)")
    last = df.groupBy(*keys).agg(F.max(packed).alias("__last"))
    return last.select(*keys, F.pmod("__last", base).cast("bigint").alias("__hash"))


def _walked(rows: DataFrame, groups: list[str], weight: str | None) -> DataFrame:
    """Sorted partitions with ``__part``, ``__before`` (rows of the same group before this one in the partition), ``__run`` (the number
    of the row's run of equal groups, from 0) and ``__edge`` (whether it is a partition's first or last row)."""
    schema = T.StructType([*rows.schema]).add("__part", T.IntegerType()).add("__before", T.LongType()).add("__run", T.LongType()).add("__edge", T.BooleanType())

    def changes(now: pa.Array, past: pa.Array) -> np.ndarray:
        """Where two neighbours differ; null equals null and NaN equals NaN."""
        other = pc.fill_null(pc.not_equal(now, past), False)
        if pa.types.is_floating(now.type):
            other = pc.and_not(other, pc.and_(pc.fill_null(pc.is_nan(now), False), pc.fill_null(pc.is_nan(past), False)))
        return np.asarray(pc.or_(other, pc.xor(pc.is_null(now), pc.is_null(past))).to_numpy(zero_copy_only=False), bool)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, upto, last, held = TaskContext.get().partitionId(), -1, 0, None, None

        def made(batch: pa.RecordBatch, before: np.ndarray, runs: np.ndarray, first: bool, end: bool) -> pa.RecordBatch:
            edge = np.zeros(len(batch), bool)
            edge[0] |= first
            edge[-1] |= end
            more = [pa.array(np.full(len(batch), part, np.int32)), pa.array(before), pa.array(runs), pa.array(edge)]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], schema=pa.schema([*batch.schema, *(pa.field(f.name, a.type) for f, a in zip(schema.fields[-4:], more))]))

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            new = np.zeros(n, bool)
            for g in groups:
                column = batch.column(g)
                new[1:] |= changes(column.slice(1), column.slice(0, n - 1))
                if last is not None:
                    new[0] |= changes(column.slice(0, 1), last.column(g))[0]
            new[0] |= last is None
            some = np.ones(n, np.int64) if weight is None else batch.column(weight).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            begun = np.cumsum(new)
            total = np.cumsum(some) - some
            starts = np.concatenate([[-upto], total[new]])
            before, runs = total - starts[begun], run + begun
            run, upto, last = int(runs[-1]), int(before[-1] + some[-1]), batch.slice(n - 1)
            if held is not None:
                yield made(*held, False)
            held = (batch, before, runs.astype(np.int64), held is None)
        if held is not None:
            yield made(*held, True)

    return rows.mapInArrow(walk, schema)


def positions(df: DataFrame, groups: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """``df`` with ``__start``, the number of rows before each row in its group by ``order``, from 0.

    With ``weight`` a row stands for so many equal rows. The rows are range-partitioned and sorted by
    group and order, so a hot group spreads over partitions, and shuffled once: every sorted partition
    counts its rows as it is walked, and only a partition's first group can have rows in partitions before it. What those
    hold is added up from the first and last row of each partition (two rows a partition, on the driver) and
    broadcast. Equal (group, order) keys share a partition: make them few by pre-aggregating with a weight, or
    unique by a last order column. Groups are of atomic types. The walked rows are checkpointed, as the bounds
    of a range partitioning are sampled anew each time.
    """
    keyed = df.repartitionByRange(*[F.col(c) for c in [*groups, *order]]).sortWithinPartitions(*groups, *order)
    keyed = cut(_walked(keyed, groups, weight))
    size = F.lit(1).cast("bigint") if weight is None else F.coalesce(F.col(weight).cast("bigint"), F.lit(0))
    ends = keyed.where("__edge").select("__part", "__run", (F.col("__before") + size).alias("__upto"), F.struct(*groups).alias("__g") if groups else F.lit(0).alias("__g"))
    carried, open_, past = [], 0, None
    for part, rows in _by_part(ends.collect()):
        first, last = rows[0], rows[-1]
        same = past is not None and _same(first["__g"], past)
        carry = open_ if same else 0
        carried.append((part, carry))
        open_ = last["__upto"] + (carry if last["__run"] == 0 else 0)
        past = last["__g"]
    offsets = df.sparkSession.createDataFrame(carried, "__opart int, __carry bigint")
    joined = keyed.join(F.broadcast(offsets), F.col("__part") == F.col("__opart"))
    start = F.col("__before") + F.when(F.col("__run") == 0, F.col("__carry")).otherwise(F.lit(0))
    return joined.select(*df.columns, start.alias("__start"))


def _by_part(rows: list) -> list[tuple[int, list]]:
    """The first and the last row of each partition, in order."""
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["__part"], r["__run"], r["__upto"])):
        out.setdefault(r["__part"], []).append(r)
    return list(out.items())


def _same(a: object, b: object) -> bool:
    values = (tuple(a), tuple(b)) if isinstance(a, tuple) else ((a,), (b,))
    return all(x == y or (x != x and y != y) for x, y in zip(*values))
