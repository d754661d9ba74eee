"""Data checks. A check is a DataFrame of the rows that break a rule; no rows, no problem."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.operators.relations import symmetric_difference


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Values, or combinations of values, that occur more than once; for one column nulls don't count."""
    rows = df.where(F.col(columns[0]).isNotNull()) if len(columns) == 1 else df
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def accepted_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Values outside; nulls pass."""
    bad = F.lit(False)
    if low is not None:
        bad |= F.col(column) < low
    if high is not None:
        bad |= F.col(column) > high
    return df.where(bad)


def full_match(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(~F.col(column).rlike(f"^(?:{pattern})$"))


def expression_is_true(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which the rule is false; an unknown rule is no failure."""
    return df.where(~rule)


def relationship(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose value has no parent; nulls pass."""
    keys = parent.select(F.col(parent_column).alias("__p")).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__p"), "left_anti")


def contract(df: DataFrame, declared: T.StructType) -> list[str]:
    """What is wrong with a table's columns: missing, not declared, or of another type."""
    have, want = ({f.name: f.dataType for f in s} for s in (df.schema, declared))
    return [
        *(f"missing: {c}" for c in want if c not in have),
        *(f"not declared: {c}" for c in have if c not in want),
        *(f"{c}: {have[c].simpleString()} is not {want[c].simpleString()}" for c in want if c in have and have[c] != want[c]),
    ]


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return symmetric_difference(a, b)


def same_counts(counts: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Pairs of tables with different numbers of rows; each side is a one-row aggregate, all in one plan."""
    rows = None
    for name, (left, right) in counts.items():
        one = left.agg(F.count(F.lit(1)).alias("left_rows")).crossJoin(right.agg(F.count(F.lit(1)).alias("right_rows"))).select(F.lit(name).alias("name"), "left_rows", "right_rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows.where(F.col("left_rows") != F.col("right_rows"))


def copies_identical(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose copies differ in some value; nulls are values."""
    return df.select(*keys, *values).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("versions")).where(F.col("versions") > 1)


def share_at_least(df: DataFrame, good: Column, least: float) -> DataFrame:
    """One row with the share of good rows if it is too small."""
    share = df.agg(F.try_divide(F.sum(F.when(good, 1).otherwise(0)), F.count(F.lit(1))).alias("share"))
    return share.where(F.col("share") < least)


def recomputes(df: DataFrame, published: Column, computed: Column, tolerance: float) -> DataFrame:
    """Rows whose published figure is not what its inputs give."""
    return df.where(F.abs(published - computed) > tolerance)


def pivot_keeps_values(long: DataFrame, key: str, name: str, value: str, wide: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Values of the long table that the pivoted one lost or changed."""
    stacked = wide.select(key, F.explode(F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), F.col(c))])).alias("__n", "__v"))
    kept = stacked.select(F.col(key).alias("__k"), "__n", "__v")
    wanted = long.where(F.col(name).isin(*columns))
    return wanted.join(kept, (F.col(key) == F.col("__k")) & (F.col(name) == F.col("__n")), "left").where(~F.col(value).eqNullSafe(F.col("__v"))).select(key, name, value)


def covers(keys: DataFrame, key: str, sources: Sequence[DataFrame]) -> DataFrame:
    """Keys of any source that the dimension lacks."""
    missing = None
    for source in sources:
        some = source.select(key).where(F.col(key).isNotNull()).join(keys.select(key), key, "left_anti")
        missing = some if missing is None else missing.union(some)
    return missing.distinct()


def golden(df: DataFrame, key: str, value: str, expected: Mapping) -> DataFrame:
    """Known records whose value is another, or that are missing; nulls are values."""
    schema = T.StructType([T.StructField("__k", df.schema[key].dataType), T.StructField("expected", df.schema[value].dataType)])
    known = df.sparkSession.createDataFrame(list(expected.items()), schema)
    found = known.join(df.select(F.col(key).alias("__f"), F.col(value).alias("found")), F.col("__k") == F.col("__f"), "left")
    return found.where(~F.col("found").eqNullSafe(F.col("expected"))).select(F.col("__k").alias(key), "expected", "found")


@dataclass
class Check:
    """A named rule. ``where`` limits it to some rows of its table; ``error`` stops what depends on the table, ``warn`` does not."""

    name: str
    failing: DataFrame
    severity: str = "error"
    where: Column | None = None


@dataclass
class Outcome:
    name: str
    severity: str
    failures: int

    @property
    def passed(self) -> bool:
        return self.failures == 0


def failure_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(``check``, ``failures``) of rules on single rows, given as what is wrong with a row: all counted in one pass over the table."""
    counts = df.agg(*[F.count_if(bad).alias(f"__{i}") for i, bad in enumerate(rules.values())])
    cells = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"__{i}").alias("failures")) for i, name in enumerate(rules)])
    return counts.select(F.explode(cells).alias("__c")).select("__c.*")


@dataclass
class Suite:
    checks: list[Check] = field(default_factory=list)
    rows: list[tuple[DataFrame, dict[str, tuple[Column, str]]]] = field(default_factory=list)

    def add(self, name: str, failing: DataFrame, severity: str = "error", where: Column | None = None) -> None:
        self.checks.append(Check(name, failing if where is None else failing.where(where), severity, where))

    def add_rows(self, df: DataFrame, rules: Mapping[str, tuple[Column, str]]) -> None:
        """Rules on single rows of one table by name: what is wrong, and the severity."""
        if rules:
            self.rows.append((df, dict(rules)))

    def run(self, audit: str | None = None) -> list[Outcome]:
        """Counts the failures of every check; with a folder, writes the failing rows of each under its name. Rules on single rows are
        counted in one pass per table, and only of those that fail are rows written."""
        out = []
        for df, rules in self.rows:
            counts = {r["check"]: r["failures"] for r in failure_counts(df, {n: bad for n, (bad, _) in rules.items()}).collect()}
            for name, (bad, severity) in rules.items():
                if audit is not None and counts[name]:
                    df.where(bad).write.mode("overwrite").parquet(f"{audit}/{name}")
                out.append(Outcome(name, severity, counts[name]))
        for check in self.checks:
            if audit is None:
                failures = check.failing.count()
            else:
                path = f"{audit}/{check.name}"
                check.failing.write.mode("overwrite").parquet(path)
                failures = check.failing.sparkSession.read.parquet(path).count()
            out.append(Outcome(check.name, check.severity, failures))
        return out


def summary(spark: SparkSession, checks: Mapping[str, DataFrame]) -> DataFrame:
    """(``check``, ``failures``) of many checks in one plan."""
    rows = None
    for name, failing in checks.items():
        one = failing.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures")
        rows = one if rows is None else rows.unionByName(one)
    return rows
