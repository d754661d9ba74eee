import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
needs_data = pytest.mark.skipif(not os.path.exists(FOLDER), reason="the test tables are not here")


def core():
    from lodestack.queries import core_pipeline, relational

    return {**core_pipeline.QUERIES, **relational.QUERIES}


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def same_as_sql(df, sql):
    duckdb = pytest.importorskip("duckdb")
    got = df.collect()
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    text = lambda v: "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v).replace("+00:00", "")
    want = sorted(tuple(text(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(tuple(text(r[c]) for c in sorted(names)) for r in got) == want


@needs_data
@pytest.mark.parametrize("name", list(core()))
def test_query_equals_sql(spark, name):
    df = core()[name](spark, FOLDER)
    if name in entry.oracle_sql():
        same_as_sql(df, entry.oracle_sql()[name])
    else:
        df.collect()


@pytest.fixture(scope="module")
def tables(spark):
    from lodestack.plans.hospital_models import HOSPITAL
    from lodestack.queries import models

    return models.built(spark, FOLDER, list(HOSPITAL.nodes)) if os.path.exists(FOLDER) else {}


@needs_data
@pytest.mark.parametrize("name", [n.removeprefix("model_") for n in entry.oracle_sql() if n.startswith("model_") and n != "model_measures"])
def test_table_equals_sql(tables, name):
    from pyspark.sql import functions as F

    from lodestack.queries import models

    df = tables[name]
    same_as_sql(df.withColumns({c: F.round(c, 6) for c in df.columns if c in models.SUMS}), entry.oracle_sql()[f"model_{name}"])


@needs_data
@pytest.mark.parametrize("name", ["dq_guards", "metric_star_states"])
def test_query_over_tables_equals_sql(spark, name):
    same_as_sql(entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_training_data_operators_stand_apart():
    for path in (ROOT / "lodestack").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"lodestack\.llm|from lodestack import .*\bllm\b", path.read_text()), path


def test_no_local_checkpoints_or_rdds():
    for path in (ROOT / "lodestack").rglob("*.py"):
        assert not re.search(r"localCheckpoint\(|\.rdd\b", path.read_text()), path
