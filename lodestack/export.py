"""Marts as Parquet files for a reporting tool, with a manifest and the figures to reconcile them by."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.ordering import percent_ranked
from lodestack.plans.semantic import MetricLayer


def export_tables(tables: Mapping[str, DataFrame], folder: str | Path) -> dict[str, int]:
    """Writes each table and ``manifest.json`` with its rows. Tables are written as they are partitioned."""
    rows = {}
    for name, df in tables.items():
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows[name] = df.sparkSession.read.parquet(path).count()
    Path(folder, "manifest.json").write_text(json.dumps(rows, indent=1))
    return rows


def export_all(layer: MetricLayer, tables: Mapping[str, DataFrame], folder: str | Path, by: str = "fiscal_year") -> dict[str, int]:
    return export_tables({**tables, "metric_checks": layer.metric_checks(by)}, folder)


def model_risk(scored: DataFrame, score: str, target: str, year: str = "fiscal_year", key: str = "facility_id", flagged: float = 0.75) -> DataFrame:
    """Predictions with their rank as a share of the year (ties share the mean rank) and whether it is above ``flagged``."""
    ranked = percent_ranked(scored.select(key, year, F.col(score).alias("predicted"), F.col(target).alias("actual")), [year], "predicted", "predicted_rank")
    return ranked.withColumn("is_flagged", F.col("predicted_rank") > flagged)


def model_drivers(parts: DataFrame, families: Sequence[str], key: str = "facility_id", year: str = "fiscal_year") -> DataFrame:
    """(key, year, ``family``, ``contribution``) from ``parts``, an array of what each input adds, by the inputs' families."""
    cells = parts.select(key, year, F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in families]).alias("family"), F.col("parts").alias("part"))).alias("c"))
    return cells.groupBy(key, year, F.col("c.family").alias("family")).agg(F.sum("c.part").alias("contribution"))


def mismatches(expected: DataFrame, recomputed: DataFrame, keys: Sequence[str], a: str, b: str, tolerance: float = 1e-6) -> DataFrame:
    """Figures that two engines disagree on by more than a relative tolerance; missing equals 0, as a sum of nothing may be either."""
    other = recomputed.select(*keys, F.col(b).alias("__b"))
    both = expected.select(*keys, F.col(a).alias("__a")).join(other, list(keys), "full_outer")
    x, y = F.coalesce("__a", F.lit(0.0)), F.coalesce("__b", F.lit(0.0))
    return both.where(F.abs(x - y) > tolerance * F.greatest(F.lit(1.0), F.abs(x))).select(*keys, F.col("__a").alias(a), F.col("__b").alias(b))


def labelled(code: Column, names: Mapping[str, str]) -> Column:
    """The label of a code; a code without one stays."""
    out = None
    for key, name in names.items():
        out = F.when(code == key, name) if out is None else out.when(code == key, name)
    return out.otherwise(code)


#: Most columns of a matrix.
MOST_COLUMNS = 1000


def matrix(df: DataFrame, row: str, column: str, value: Column) -> DataFrame:
    """Rows by columns with one figure each; there is a column for every value of ``column``, in order."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} values")
    return df.groupBy(row).pivot(column, found).agg(value)


def model_measures(risk: DataFrame, top: str, by: Sequence[str] = ("fiscal_year",)) -> DataFrame:
    """Of scored rows: how many are flagged, the share of these that are in the top group (``top``, a boolean column), and mean prediction and
    mean figure; null where nothing is flagged."""
    flagged = F.count_if("is_flagged")
    return risk.groupBy(*by).agg(
        flagged.alias("flagged"), F.try_divide(F.count_if(F.col("is_flagged") & F.col(top)), flagged).alias("flag_precision"), F.avg("predicted").alias("avg_predicted"), F.avg("actual").alias("avg_actual")
    )


#: The relationships of the exported tables, many to one: (table, column) to (table, column).
RELATIONSHIPS = {
    ("fct_hospital_year", "facility_id"): ("dim_hospital", "facility_id"),
    ("fct_hospital_year", "fiscal_year"): ("dim_fiscal_year", "fiscal_year"),
    ("fct_readmissions", "facility_id"): ("dim_hospital", "facility_id"),
    ("fct_readmissions", "fiscal_year"): ("dim_fiscal_year", "fiscal_year"),
    ("dim_hospital", "county_fips"): ("dim_county", "county_fips"),
    ("model_risk", "facility_id"): ("dim_hospital", "facility_id"),
    ("model_risk", "fiscal_year"): ("dim_fiscal_year", "fiscal_year"),
}


def propagated(tables: Mapping[str, DataFrame], selections: Mapping[str, Column], relationships: Mapping[tuple[str, str], tuple[str, str]] = RELATIONSHIPS) -> dict[str, DataFrame]:
    """Tables as a report shows them under ``selections`` (table to condition): a selection filters its table and, from one to many, every
    table that leads to it, directly or through others; it never goes the other way. Each step is a semi-join."""
    done: dict[str, DataFrame] = {}
    narrowed: set[str] = set()

    def shown(name: str) -> DataFrame:
        if name not in done:
            df = tables[name]
            if name in selections:
                df = df.where(selections[name])
                narrowed.add(name)
            for (table, column), (parent, key) in relationships.items():
                if table == name and parent in tables:
                    above = shown(parent)
                    if parent in narrowed:
                        narrowed.add(name)
                        df = df.join(above.select(F.col(key).alias("__p")), F.col(column) == F.col("__p"), "left_semi")
            done[name] = df
        return done[name]

    return {name: shown(name) for name in tables}


def rounded(value, digits: int = 4):
    """Figures of a report for JSON: rounded, NaN as null."""
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [rounded(v, digits) for v in value]
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, digits)
    return value
