import datetime
import random

import numpy as np
import pytest

from lodestack.llm import quantiles as Q

PS = [0.0, 0.1, 0.5, 0.9, 1.0]


def sample(spark, n=800):
    rng = random.Random(2)
    # One group holds most rows, one value most of them.
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([1.0, 1.0, 1.0, None, float("nan"), round(rng.lognormvariate(0, 1), 2)]), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v double, n int"), rows


def brute(rows, p):
    out = {}
    for g in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]]
        if values:
            out[g] = float(np.quantile(values, p))
    return out


def test_exact(spark):
    df, rows = sample(spark)
    got = Q.quantiles(Q.quantile_state(df, ["g"], "v"), ["g"], "v", PS).collect()
    for p in PS:
        assert {r["g"]: r["quantile"] for r in got if r["probability"] == p} == pytest.approx(brute(rows, p))


def test_states_merge(spark):
    df, rows = sample(spark)
    parts = [Q.quantile_state(df.where(f"n = {i}"), ["g"], "v") for i in range(3)]
    whole = Q.merge_states(parts[2], parts[0], parts[1])
    assert sorted(map(str, whole.collect())) == sorted(map(str, Q.quantile_state(df, ["g"], "v").collect()))
    got = {r["g"]: r["quantile"] for r in Q.quantiles(whole, ["g"], "v", [0.5]).collect()}
    assert got == pytest.approx(brute(rows, 0.5))


def test_bounded_error(spark):
    df, rows = sample(spark)
    got = {r["g"]: r["quantile"] for r in Q.quantiles(Q.quantile_state(df, ["g"], "v", resolution=0.1), ["g"], "v", [0.9]).collect()}
    want = brute(rows, 0.9)
    assert all(abs(got[g] - want[g]) <= 0.05 + 1e-9 for g in want)


def test_nothing(spark):
    df, _ = sample(spark)
    assert Q.quantiles(Q.quantile_state(df.limit(0), ["g"], "v"), ["g"], "v", PS).count() == 0
    assert Q.quantiles(Q.quantile_state(df.where("v is null"), ["g"], "v"), ["g"], "v", PS).count() == 0
    one = spark.createDataFrame([("x", 3.0)], "g string, v double")
    assert {r["quantile"] for r in Q.quantiles(Q.quantile_state(one, ["g"], "v"), ["g"], "v", PS).collect()} == {3.0}


def test_median_differences(spark):
    t = datetime.datetime(2020, 1, 1)
    facts = [("FY", "HF", f"h{i}", True, 1.0 + i / 10, 1.2, "x") for i in range(5)] + [("FY", "HF", "h0", True, 1.0, 1.2, "x")] * 3
    facts += [("FY", "AMI", f"h{i}", True, 1.0 + i / 10, 1.3, "x") for i in range(4)] + [("FY", "AMI", "h9", False, 9.0, 1.3, "x"), ("FY", "AMI", "h5", True, None, 1.3, "x")]
    facts = spark.createDataFrame(facts, "fiscal_year string, condition string, facility_id string, in_payment_file boolean, excess_readmission_ratio double, peer_group_median_err double, peer_group string")
    paid = [(f"h{i}", "FY", 1, t) for i in range(10)] + [("h0", "FY", 2, t - datetime.timedelta(1)), ("h4", "FY", None, t + datetime.timedelta(1)), (None, "FY", 1, t)]
    paid = spark.createDataFrame(paid, "facility_id string, fiscal_year string, peer_group int, ingested_at timestamp")
    # h4's last group is null, so HF has 1.0 to 1.3: the median is 1.15, published 1.2; AMI's is 1.15, published 1.3.
    got = {r["condition"]: (round(r["median"], 6), r["published"], r["n"]) for r in Q.median_differences(Q.peer_ratios(facts, paid), 0.01).collect()}
    assert got == {"HF": (1.15, 1.2, 4), "AMI": (1.15, 1.3, 4)}
    assert Q.median_differences(Q.peer_ratios(facts, paid), 0.2).count() == 0
