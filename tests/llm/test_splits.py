import random

from lodestack.llm import splits as S

EDGES = "old string, new string, root string"


def edges(spark, pairs):
    return spark.createDataFrame([(*p, "x") for p in pairs], EDGES)


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a.strip() and b.strip() and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent if parent}


def test_forest_equals_union_find(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randint(0, 80):02d}", f"n{rng.randint(0, 80):02d}") for _ in range(60)]
    pairs += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [("hub", f"s{i}") for i in range(30)]
    pairs += [(b, a) for a, b in pairs[:20]] + pairs[:10] + [("x", None), (None, "x"), ("y", " "), ("z", "z")]
    forest, labels = S.spanning_forest(edges(spark, pairs), "old", "new")
    want = {n: r for n, r in components(pairs).items()}
    assert {r["node"]: r["root"] for r in labels.collect()} == want
    kept = [(r["a"], r["b"]) for r in forest.collect()]
    assert components(kept) == want and len(kept) == len(want) - len(set(want.values()))


def test_no_edges(spark):
    for pairs in ([("a", "a")], [("a", None)]):
        forest, labels = S.spanning_forest(edges(spark, pairs), "old", "new")
        assert forest.count() == 0 and labels.count() == 0
    assert S.spanning_forest(edges(spark, [("a", "b")]).limit(0), "old", "new")[1].count() == 0


def test_leaks(spark):
    rows = [("a", " Train "), ("b", "TEST"), ("c", "train"), ("c", "train"), ("c", None), ("d", "test"), ("d", "validation"), ("e", None), ("f", ""), ("f", "test"), (None, "test")]
    rows = spark.createDataFrame([(*r, "x") for r in rows], "id string, split string, group_id string")
    _, labels = S.spanning_forest(edges(spark, [("z", "a"), ("b", "z")]), "old", "new")
    got = S.leaking_groups(S.grouped_rows(rows.where("id is not null"), labels, "id"), "split")
    assert sorted(r[0] for r in got.collect()) == ["a", "d"]


def test_splits_keep_groups_and_proportions(spark):
    rng = random.Random(6)
    ids = [f"h{i:04d}" for i in range(1500)]
    rows = spark.createDataFrame([(i, y, "old", 1) for i in ids for y in range(rng.choice([1, 2, 7, 8]))] + [(None, 0, "old", 1)], "id string, y int, split string, rows int")
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(150)]
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    out = S.assign_splits(rows, edges(spark, pairs), "id", "old", "new", shares).toPandas()
    assert len(out) == rows.count() and set(out["split"]) == set(shares)
    assert out.groupby("group_id")["split"].nunique().max() == 1
    share = out["split"].value_counts(normalize=True)
    assert all(abs(share[s] - w) < 0.03 for s, w in shares.items())
    again = S.assign_splits(rows, edges(spark, pairs), "id", "old", "new", shares).toPandas()
    assert dict(zip(out["group_id"], out["split"])) == dict(zip(again["group_id"], again["split"]))


def test_one_giant_group_goes_first(spark):
    rows = spark.createDataFrame([("a", i) for i in range(400)] + [(f"x{i}", 0) for i in range(100)], "id string, y int")
    out = S.assign_splits(rows, edges(spark, [("a", "b")]), "id", "old", "new", {"train": 0.8, "test": 0.2}).toPandas()
    assert set(out[out.id == "a"]["split"]) == {"train"}
