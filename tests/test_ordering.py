import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestack.operators import ordering as O
from lodestack.operators.ranking import last_row, positions


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[round(rng.gauss(0, 1), 1) for _ in range(3)]]), rng.random(), rng.random() < 0.4) for _ in range(600)]
    return spark.createDataFrame(rows, "g string, v double, w double, y boolean")


def test_positions_are_places(spark, sample):
    placed = positions(sample, ["g"], ["w"]).toPandas()
    for _, part in placed.groupby("g", dropna=False):
        assert sorted(part["__start"]) == list(range(len(part)))
        assert part.sort_values("w")["__start"].is_monotonic_increasing


def test_positions_with_weight(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("a", 5, 1), ("b", 1, 4)], "g string, v int, n int")
    assert {(r["g"], r["v"]): r["__start"] for r in positions(df, ["g"], ["v"], "n").collect()} == {("a", 1): 0, ("a", 2): 3, ("a", 5): 5, ("b", 1): 0}


def test_quantiles_and_ranks(sample):
    pdf = sample.toPandas()
    got = {r["g"]: r for r in O.group_quantiles(sample, ["g"], "v", [0.25, 0.5]).collect()}
    for g, part in pdf.dropna(subset=["v"]).groupby("g", dropna=False):
        key = None if pd.isna(g) else g
        assert got[key]["q0"] == pytest.approx(part["v"].quantile(0.25)) and got[key]["q1"] == pytest.approx(part["v"].quantile(0.5))
    ranked = O.percent_ranked(sample, ["g"], "v", "p").toPandas()
    want = ranked.groupby("g", dropna=False)["v"].rank(pct=True)
    assert ranked["p"].dropna().tolist() == pytest.approx(want.dropna().tolist())


def test_spearman_and_auc(sample):
    pdf = sample.toPandas().dropna(subset=["v"])
    rho = {r["g"]: r["rho"] for r in O.spearman(sample, ["g"], "v", "w").collect()}
    assert rho["a"] == pytest.approx(pdf[pdf.g == "a"][["v", "w"]].rank().corr().iloc[0, 1])
    part = pdf[pdf.g == "b"]
    pairs = [(p > n) + 0.5 * (p == n) for p in part[part.y]["v"] for n in part[~part.y]["v"]]
    assert {r["g"]: r["auc"] for r in O.auc(sample, ["g"], "y", "v").collect()}["b"] == pytest.approx(sum(pairs) / len(pairs))


def test_constant_and_single_class(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, True), ("a", 1.0, 2.0, True)], "g string, v double, w double, y boolean")
    assert O.spearman(df, ["g"], "v", "w").first()["rho"] is None and O.auc(df, ["g"], "y", "w").first()["auc"] is None


def test_buckets_keep_ties_together(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 1, 1, 1, 2, 3, 4, 5]], "g string, v double")
    out = O.bucketed(df, ["g"], "v", 4, "b").toPandas()
    assert out.groupby("v")["b"].nunique().max() == 1 and out["b"].min() == 1 and out["b"].max() == 4


def test_last_row_ties(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 1, "y"), ("k", None, "z")], "k string, at int, v string")
    assert last_row(df, ["k"], ["v"], ["at"]).collect() == last_row(df.orderBy(F.desc("v")), ["k"], ["v"], ["at"]).collect()


def test_empty(sample):
    none = sample.limit(0)
    assert positions(none, ["g"], ["w"]).count() == 0 and O.group_quantiles(none, ["g"], "v", [0.5]).count() == 0
