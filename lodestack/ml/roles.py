"""Column roles of a modelling table, kept in its schema, and the guard of an honest split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = ("key", "split", "target", "target_view", "feature", "variant_feature")


class SplitError(ValueError):
    """A split in which the model would see what it is tested on."""


@dataclass(frozen=True)
class Roles:
    by_column: Mapping[str, str]
    family: Mapping[str, str]

    def of(self, role: str) -> list[str]:
        return [c for c, r in self.by_column.items() if r == role]


def with_roles(df: DataFrame, roles: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with each column's role and family in its metadata, which Parquet keeps."""
    return df.select(*[F.col(c).alias(c, metadata={"role": roles[c][0], "family": roles[c][1]}) if c in roles else F.col(c) for c in df.columns])


def roles_of(schema: T.StructType) -> Roles:
    named = {f.name: f.metadata for f in schema if f.metadata.get("role")}
    wrong = [c for c, m in named.items() if m["role"] not in ROLES]
    if wrong:
        raise ValueError(f"unknown roles of {', '.join(wrong)}")
    return Roles({c: m["role"] for c, m in named.items()}, {c: m.get("family", "") for c, m in named.items()})


def feature_types(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numbers and booleans, and texts."""
    kinds = {f.name: f.dataType for f in df.schema}
    texts = [c for c in features if isinstance(kinds[c], T.StringType)]
    return [c for c in features if c not in texts], texts


def honest_split(df: DataFrame, split: str = "split", year: str = "fiscal_year", train: str = "train", test: str = "test") -> tuple[DataFrame, DataFrame]:
    """Training and test rows, if there is one test year, no year is on both sides, and there are training rows."""
    years = df.where(F.col(split).isin(train, test)).groupBy(year).agg(F.collect_set(split).alias("sides")).collect()
    tested = [r[year] for r in years if test in r["sides"]]
    if len(tested) != 1:
        raise SplitError(f"there are {len(tested)} test years; one is needed")
    if any(len(r["sides"]) > 1 for r in years):
        raise SplitError("a year is in both training and test")
    if len(years) < 2:
        raise SplitError("there are no training rows")
    return df.where(F.col(split) == train), df.where(F.col(split) == test)
