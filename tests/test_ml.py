import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestack.ml import metrics as M
from lodestack.ml import models as D
from lodestack.ml import roles as R
from lodestack.ml import train as N
from lodestack.operators.ordering import top_share_flag

TARGET, FEATURES = "payment_reduction_pct", ["driver", "ownership", "flag"]


@pytest.fixture(scope="module")
def years(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(150):
        driver = rng.normal()
        for y in (2020, 2023, 2026):
            pct = float(np.clip(0.6 + 0.4 * driver + rng.normal(0, 0.2), 0, 3))
            rows.append((f"{i:06d}", f"FY{y}", "test" if y == 2026 else "train", pct, None if rng.random() < 0.1 else float(driver), ["a", "b"][i % 2], bool(i % 3), pct > 0.1))
    df = spark.createDataFrame(rows, "facility_id string, fiscal_year string, split string, payment_reduction_pct double, driver double, ownership string, flag boolean, is_penalized boolean")
    return top_share_flag(df, ["fiscal_year"], TARGET, 0.75, "is_top_quarter_penalty").cache()


def test_roles(spark, years, tmp_path):
    marked = R.with_roles(years, {"facility_id": ("key", ""), "driver": ("feature", "volume")})
    marked.write.parquet(f"{tmp_path}/t")
    roles = R.roles_of(spark.read.parquet(f"{tmp_path}/t").schema)
    assert roles.of("feature") == ["driver"] and roles.family["driver"] == "volume"
    with pytest.raises(ValueError):
        R.roles_of(R.with_roles(years, {"driver": ("wrong", "")}).schema)
    assert R.feature_types(years, FEATURES) == (["driver", "flag"], ["ownership"])


def test_split_guard(years):
    train, test = R.honest_split(years)
    assert train.count() == 300 and test.count() == 150
    for wrong in (F.lit("train"), F.when(F.col("facility_id") < "000010", "train").otherwise(F.col("split")), F.when(F.col("fiscal_year") != "FY2020", "test").otherwise("train"), F.when(F.col("split") == "test", "test")):
        with pytest.raises(R.SplitError):
            R.honest_split(years.withColumn("split", wrong))


def test_models_rank(years):
    train, test = R.honest_split(years)
    for fitted in (D.fit_ridge(train, FEATURES, TARGET, 1.0), D.fit_additive(train, FEATURES, TARGET, 8), D.fit_trees(train, FEATURES, TARGET, trees=10, depth=3)):
        scored = fitted.score(test)
        assert M.within_year_metrics(scored, "score")["auc_top_quarter"] > 0.8, fitted.family
        fitted.score(test.withColumn("ownership", F.lit("unseen"))).count()


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    model = D.fit_ridge(df, ["a", "b"], "y", alpha=50.0)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.solve(z.T @ z + 50 * np.eye(2), z.T @ (y - y.mean()))
    got = {n: v for n, v in D.coefficients(model, df)}
    assert [got["i_a"], got["i_b"]] == pytest.approx(want, rel=0.02)
    row = D.contributions(model, df).first()
    assert row["base"] + sum(row["parts"]) == pytest.approx(row["score"])


def test_baselines(years):
    train, test = R.honest_split(years)
    assert D.training_mean(train, test, TARGET).select("score").distinct().count() == 1
    own = D.earlier_value(years, test.where("facility_id <= '000001'"), 3, TARGET, F.lit(-1.0)).select("facility_id", "score").collect()
    past = {r["facility_id"]: r[TARGET] for r in years.where("fiscal_year = 'FY2023'").collect()}
    assert {r["facility_id"]: r["score"] for r in own} == {k: past[k] for k in ("000000", "000001")}
    assert D.earlier_value(years, years.where("fiscal_year = 'FY2020'"), 3, TARGET, F.lit(-1.0)).where("score <> -1").count() == 0


def test_metrics(years):
    test = years.where("split = 'test'")
    perfect = M.within_year_metrics(test.withColumn("s", F.col(TARGET)), "s")
    assert perfect["auc_top_quarter"] == 1.0 and perfect["spearman"] == pytest.approx(1.0) and perfect["mae_pct"] == 0
    flat = M.within_year_metrics(test.withColumn("s", F.lit(1.0)), "s")
    assert flat["auc_top_quarter"] == 0.5 and math.isnan(flat["spearman"])
    assert M.within_year_metrics(test.withColumn("s", -F.col(TARGET)), "s")["auc_top_quarter"] == 0.0


def test_bootstrap(years):
    test = years.where("split = 'test'").withColumns({"good": F.col(TARGET) + F.rand(1) * 0.3, "bad": F.rand(2)}).cache()
    low, high = M.bootstrap_interval(test, "good", "auc_top_quarter", n=40)
    assert low <= M.within_year_metrics(test, "good")["auc_top_quarter"] <= high
    assert (low, high) == M.bootstrap_interval(test, "good", "auc_top_quarter", n=40)
    assert M.bootstrap_difference(test, "good", "bad", "spearman", n=20)["share_better"] == 1.0
    with pytest.raises(ValueError):
        M.bootstrap(years, [TARGET], "spearman")


def test_a_thousand_draws(spark):
    import inspect

    from lodestack.queries import relational

    draws = relational.bootstrap_draws(spark, "/root/testdata/sf0.001")
    assert draws.select("draw").distinct().count() == draws.count() == 1000
    assert inspect.signature(N.run).parameters["draws"].default == 1000


def test_surveyed_grids():
    from lodestack.queries import relational

    assert {0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0} <= {p["alpha"] for p in N.FAMILIES["ridge"][1]}
    trees = N.FAMILIES["trees"][1]
    assert len({tuple(p.values()) for p in trees}) == 12 and {p["trees"] for p in trees} == {300, 600} and {p["least"] for p in trees} == {50, 200} and {2 ** p["depth"] for p in trees} == {8, 16, 32}
    assert "tuned_ridge_scores" in relational.QUERIES


def test_folds_and_choice(years):
    folds = N.grouped_folds(years).groupBy("facility_id").agg(F.count_distinct("fold").alias("n"))
    assert folds.where("n > 1").count() == 0
    assert N.choose({"ridge": 0.700, "additive": 0.705, "trees": 0.709}) == "ridge"
    assert N.choose({"ridge": 0.680, "additive": 0.715, "trees": 0.720}) == "additive"
    assert N.choose({"ridge": 0.680, "additive": 0.700, "trees": 0.720}) == "trees"
    assert all(a.count() and b.count() for a, b in N.naive_splits(years).values())


def test_report(years, tmp_path):
    report = N.run(years, FEATURES, TARGET, ["ridge"], k=2, draws=10, grids={"ridge": [{"alpha": 1.0}, {"alpha": 10.0}]})
    assert report["chosen"] == "ridge" and report["rows"] == {"train": 300, "test": 150} and report["models"]["own_earlier"]["test"]["auc_top_quarter"] > 0.7
    N.write_report(report, tmp_path)
    assert (tmp_path / "metrics.json").exists()
    assert N.lift(years, "flag", TARGET, "is_top_quarter_penalty").count() == 2
