import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import packing as P


def fewest(items, capacity):
    best, items = [len(items)], sorted(items, reverse=True)

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[j] += items[i]
            put(i + 1, bins)
            bins[j] -= items[i]
        bins.append(items[i])
        put(i + 1, bins)
        bins.pop()

    put(0, [])
    return best[0]


def packed(patterns, capacity):
    out = Counter()
    for n, items in patterns:
        assert n > 0 and sum(s * k for s, k in items.items()) <= capacity
        for s, k in items.items():
            out[s] += n * k
    return out


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 40), st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=12))
def test_plans_hold_every_item(capacity, counts):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    assert packed(P.plan(counts, capacity), capacity) == Counter(counts)


@settings(max_examples=150, deadline=None)
@given(st.integers(6, 20), st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominance_keeps_an_optimum(capacity, items):
    items = [min(i, capacity) for i in items]
    fixed, rest = P.dominance(Counter(items), capacity)
    assert sum(n for n, _ in fixed) + fewest(list(Counter(rest).elements()), capacity) == fewest(items, capacity)


def test_little_space_is_unused():
    rng = random.Random(1)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(5, 1.1)))) for _ in range(200_000))
    patterns = P.plan(counts, 2048)
    assert sum(n for n, _ in patterns) <= 1.001 * sum(s * n for s, n in counts.items()) / 2048 + 1
    assert len(patterns) < 20_000


SCHEMA = "doc string, size bigint, piece int, container_id int"


def frame(spark, sizes):
    return spark.createDataFrame([(f"d{i}", s, 9, 9) for i, s in enumerate(sizes)], SCHEMA)


def test_pack(spark):
    rng = random.Random(8)
    sizes = [rng.choice([0, None, 3, 3, 3, 7, 10, 11, 25, 30]) for _ in range(500)]
    out = P.pack(frame(spark, sizes), "doc", "size", 10).toPandas()
    assert out.groupby("container_id")["size"].sum().max() <= 10
    whole = out.groupby("doc")["size"].sum()
    assert all(whole[f"d{i}"] == (s or 0) for i, s in enumerate(sizes))
    pieces = out.groupby("doc")["piece"].count()
    assert all(pieces[f"d{i}"] == max(1, -(-(s or 0) // 10)) for i, s in enumerate(sizes))
    assert (out["start"] == out["piece"] * 10).all()
    filled = out.groupby("container_id")["size"].sum()
    assert len(filled) <= fewest_bound(out["size"]) * 1.2
    report = P.packing_report(P.pack(frame(spark, sizes), "doc", "size", 10), 10).first()
    assert report["containers"] == len(filled) and report["tokens"] == sum(s or 0 for s in sizes)


def fewest_bound(sizes):
    return max(-(-sizes.sum() // 10), (sizes > 5).sum())


@pytest.mark.parametrize("sizes,containers", [([], 0), ([0, None, 0], 1), ([10], 1), ([4, 4, 4, 4], 2), ([100], 10)])
def test_small_cases(spark, sizes, containers):
    assert P.pack(frame(spark, sizes), "doc", "size", 10).select("container_id").distinct().count() == containers


def test_repeated_rows(spark):
    df = spark.createDataFrame([("a", 6), ("a", 6), (None, 4), (None, 4)], "doc string, size bigint")
    out = P.pack(df, "doc", "size", 10).toPandas()
    assert len(out) == 4 and out.groupby("container_id")["size"].sum().tolist() == [10, 10]
