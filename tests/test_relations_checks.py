import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack import checks as C
from lodestack import export as X
from lodestack.operators import relations as R

D = datetime.date


def test_releases(spark, rows):
    df = spark.createDataFrame([("r1", "p", 1), ("r2", "p", 2), ("r2", "q", 3), ("r3", None, 4)], "r string, s string, v int").withColumn("e", F.lit("e"))
    kept = R.latest_snapshot_per_period(df, "r", "s", "e")
    assert rows(kept.select("r", "s", "v", "_period_first_release", "_period_snapshots")) == rows(
        spark.createDataFrame([("r2", "p", 2, "r1", 2), ("r2", "q", 3, "r2", 1), ("r3", None, 4, "r3", 1)], "r string, s string, v int, f string, n long")
    )
    assert rows(R.latest_release(df, "r").select("v")) == [(4,)]


def test_footers_and_names(spark):
    df = spark.createDataFrame([("1",), (" End of Worksheet ",), ("",), (None,)], "`City/Town` string")
    assert R.without_footers(df.withColumnRenamed("City/Town", "k"), "k", ["end of worksheet"]).count() == 1
    assert df.select(R.either(df, "City", "city/town").alias("c"), R.either(df, "Nope").alias("n")).first()["c"] == "1"


def test_asof(spark, rows):
    left = spark.createDataFrame([(1, D(2020, 6, 30)), (2, D(2019, 1, 1)), (3, None)], "i int, at date")
    windows = spark.createDataFrame([(D(2019, 7, 1), D(2020, 6, 30)), (D(2019, 10, 1), D(2020, 6, 30)), (D(2019, 1, 1), D(2019, 12, 31)), (None, None)], "s date, e date")
    want = [(1, D(2020, 6, 30), D(2019, 7, 1), D(2020, 6, 30)), (2, D(2019, 1, 1), None, None), (3, None, None, None)]
    assert sorted(tuple(r) for r in R.asof_window(left, windows, "at", "s", "e").select("i", "at", "s", "e").collect()) == want


def test_asof_with_many_windows(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_WINDOWS", 0)
    test_asof(spark, None)


def test_nearest(spark):
    left = spark.createDataFrame([("k", D(2020, 1, 5)), ("k", D(2020, 3, 1)), ("z", D(2020, 1, 1))], "k string, at date")
    right = spark.createDataFrame([("k", D(2020, 1, 1), "a"), ("k", D(2020, 1, 9), "b"), ("k", None, "c")], "k string, t date, v string")
    got = sorted((r["k"], r["at"].month, r["v"]) for r in R.nearest_snapshot(left, right, ["k"], "at", "t", ["v"]).collect())
    assert got == [("k", 1, "b"), ("k", 3, "b"), ("z", 1, None)]
    again = sorted((r["k"], r["at"].month, r["v"]) for r in R.asof_keyed(left, right, ["k"], "at", "t", ["v"]).collect())
    assert again == [("k", 1, "a"), ("k", 3, "b"), ("z", 1, None)]


def test_reshaping(spark, rows):
    wide = spark.createDataFrame([("x", "1", 10, None, 20), ("y", "2", 30, "3", 40)], "k string, a string, av int, b string, bv int")
    long = R.unpivoted(wide, ["k"], "n", {"A": {"p": F.col("a"), "v": F.col("av")}, "B": {"p": F.col("b"), "v": F.col("bv")}}, "p")
    assert rows(long.select("k", "n", "v")) == [("x", "A", 10), ("y", "A", 30), ("y", "B", 40)]
    back = long.groupBy("k").agg(*R.pivoted("n", "v", {"A": "a", "B": "b"}))
    assert rows(back) == [("x", 10, None), ("y", 30, 40)]
    assert C.pivot_keeps_values(long, "k", "n", "v", back, {"A": "a", "B": "b"}).count() == 0
    assert C.pivot_keeps_values(long, "k", "n", "v", back.withColumn("b", F.lit(1)), {"A": "a", "B": "b"}).count() == 1


def test_choices(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", None)], "k string, v int")
    assert rows(R.rows_at_max(df, ["k"], "v")) == [("a", 2), ("a", 2)]
    assert rows(R.top_rows(df, ["k"], [F.col("v").desc_nulls_last()])) == rows(spark.createDataFrame([("a", 2), ("b", None)], df.schema))
    assert [r["f"] for r in R.latest_flag(df, "v", "f").orderBy("v").collect()] == [None, False, True, True]
    assert rows(R.unique_match(df.select("k").distinct(), df, ["k"], "v")) == rows(spark.createDataFrame([("a", None), ("b", None)], df.schema))
    assert rows(R.top_n_members(df, "k", F.sum("v"), 1)) == [("a", 1), ("a", 2), ("a", 2)]
    assert [r["v"] for r in R.ordered(df, ["-v"], 2).collect()] == [2, 2]


def test_three_values_and_ladders(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (2, 2)], "a int, b int")
    got = [(r["d"], r["l"]) for r in df.select(R.differs(F.col("a"), F.col("b")).alias("d"), R.ladder([(F.col("a") == F.col("b"), "same"), (F.col("a").isNotNull(), "other")], "none").alias("l")).collect()]
    assert got == [(True, "other"), (None, "none"), (False, "same")]


def test_calendar(spark):
    days = R.calendar(spark, "2020-02-27", "2020-03-02")
    assert [r[0].day for r in days.collect()] == [27, 28, 29, 1]


def test_checks(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, None), (None, 5, "y")], "k string, v int, t string")
    assert C.not_null(df, "k").count() == 1 and C.unique(df, "k").count() == 1 and C.unique(df, "k", "v").count() == 1
    assert C.accepted_values(df, "t", ["x"]).count() == 1 and C.accepted_range(df, "v", 1, 4).count() == 1
    assert C.expression_is_true(df, F.col("t") == "x").count() == 1 and C.full_match(df, "k", "[b-z]").count() == 2 - 1 + 1
    assert C.relationship(df, "t", df.where("t = 'x'"), "t").count() == 1
    assert C.copies_identical(df, ["k"], ["t"]).count() == 1 and C.share_at_least(df, F.col("v") == 1, 0.9).count() == 1
    assert C.contract(df, T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("z", T.LongType())])) == ["missing: z", "not declared: t", "v: int is not bigint"]
    assert C.covers(df, "k", [df, spark.createDataFrame([("q",)], "k string")]).count() == 1
    assert C.same_rows(df, df.limit(2)).count() in (1, 2) and C.recomputes(df, F.col("v"), F.lit(1), 0.5).count() == 1


def test_golden_and_one_to_one(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    assert {r["k"]: r["found"] for r in C.golden(df, "k", "v", {"a": "1", "b": "3", "c": "4"}).collect()} == {"b": "2", "c": None}
    assert R.one_to_one(df, df, ["k"]).count() == 2
    with pytest.raises(ValueError):
        R.one_to_one(df, df.union(df), ["k"])


def test_model_exports(spark):
    df = spark.createDataFrame([("a", "F", 1.0, 0.0), ("b", "F", 1.0, 0.0), ("c", "F", 3.0, 0.0), ("d", "F", 4.0, 0.0)], "facility_id string, fiscal_year string, s double, t double")
    assert {r["facility_id"]: (r["predicted_rank"], r["is_flagged"]) for r in X.model_risk(df, "s", "t").collect()} == {"a": (0.375, False), "b": (0.375, False), "c": (0.75, False), "d": (1.0, True)}
    parts = df.limit(1).withColumn("parts", F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)))
    assert {r["family"]: r["contribution"] for r in X.model_drivers(parts, ["x", "y", "x"]).collect()} == {"x": 5.0, "y": 2.0}


def test_suite(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 9)], "k string, v int")
    suite = C.Suite()
    suite.add("range", C.accepted_range(df, "v", 0, 5), "warn", F.col("k") == "b")
    suite.add("nulls", C.not_null(df, "k"))
    out = suite.run(str(tmp_path))
    assert [(o.name, o.passed, o.severity) for o in out] == [("range", False, "warn"), ("nulls", True, "error")]
    assert spark.read.parquet(f"{tmp_path}/range").count() == 1


def test_export(spark, tmp_path):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", None)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0000000001), ("y", 3.0)], "k string, w double")
    assert [r["k"] for r in X.mismatches(a, b, ["k"], "v", "w").collect()] == ["y"]
    assert X.export_tables({"a": a}, tmp_path) == {"a": 3} and (tmp_path / "manifest.json").exists()
    assert X.rounded({"a": float("nan"), "b": [0.123456]}) == {"a": None, "b": [0.1235]}
    assert X.matrix(a, "k", "v", F.count(F.lit(1))).count() == 3


@pytest.mark.parametrize("a,b,want", [(D(2020, 1, 31), D(2020, 2, 1), 1), (D(2019, 7, 1), D(2020, 7, 1), 12)])
def test_months(spark, a, b, want):
    assert spark.range(1).select(R.months_between_starts(F.lit(a), F.lit(b)).alias("m")).first()["m"] == want


def test_selections_propagate_one_way(spark):
    counties = spark.createDataFrame([("c1", "TX"), ("c2", "AL")], "county_fips string, state string")
    hospitals = spark.createDataFrame([("h1", "c1"), ("h2", "c2"), ("h3", None)], "facility_id string, county_fips string")
    facts = spark.createDataFrame([("h1", "FY1"), ("h2", "FY1"), ("h1", "FY2"), (None, "FY1")], "facility_id string, fiscal_year string")
    tables = {"fct_readmissions": facts, "dim_hospital": hospitals, "dim_county": counties}
    count = lambda selections: {n: df.count() for n, df in X.propagated(tables, selections).items()}
    assert count({"dim_county": F.col("state") == "TX"}) == {"fct_readmissions": 2, "dim_hospital": 1, "dim_county": 1}
    assert count({"fct_readmissions": F.col("fiscal_year") == "FY2"}) == {"fct_readmissions": 1, "dim_hospital": 3, "dim_county": 2}
    assert count({}) == {"fct_readmissions": 4, "dim_hospital": 3, "dim_county": 2}


def test_measures_of_scored_rows(spark):
    risk = spark.createDataFrame([("FY1", True, True, 1.0, 2.0), ("FY1", True, False, 3.0, 2.0), ("FY1", False, None, 0.0, None), ("FY2", False, True, 1.0, 1.0)], "fiscal_year string, is_flagged boolean, top boolean, predicted double, actual double")
    got = {r["fiscal_year"]: tuple(r)[1:] for r in X.model_measures(risk, "top").collect()}
    assert got == {"FY1": (2, 0.5, 4 / 3, 2.0), "FY2": (0, None, 1.0, 1.0)}


def test_rows_at_max_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), (None, 5), (None, 4), ("b", None)], "k string, v int")
    assert sorted(((r["k"], r["v"]) for r in R.rows_at_max(df, ["k"], "v").collect()), key=str) == sorted([("a", 2), ("a", 2), (None, 5)], key=str)


def test_windows_beyond_the_limit(spark, rows, monkeypatch):
    """The way for many windows gives the same as the one for few."""
    import datetime

    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    left = spark.createDataFrame([(i, day(i * 7 % 40)) for i in range(40)] + [(99, None), (98, day(-5))], "i int, at date")
    windows = spark.createDataFrame([(day(n - 5), day(n)) for n in range(3, 36, 4)] + [(day(0), day(11)), (day(1), None)], "s date, e date")
    few = rows(R.asof_window(left, windows, "at", "s", "e").select("i", "at", "s", "e"))
    monkeypatch.setattr(R, "MOST_WINDOWS", 2)
    assert rows(R.asof_window(left, windows, "at", "s", "e").select("i", "at", "s", "e")) == few


def test_failures_of_many_rules_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "n int, s string")
    suite = C.Suite()
    suite.add_rows(df, {"n_known": (F.col("n").isNull(), "error"), "s_known": (F.col("s").isNull(), "warn"), "small": (F.col("n") > 5, "error")})
    assert [(o.name, o.severity, o.failures) for o in suite.run(str(tmp_path))] == [("n_known", "error", 1), ("s_known", "warn", 1), ("small", "error", 0)]
    assert spark.read.parquet(f"{tmp_path}/n_known").count() == 1 and not (tmp_path / "small").exists()
