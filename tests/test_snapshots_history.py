import datetime
import random

import pytest

from lodestack.operators.history import validity_history
from lodestack.operators.snapshots import snapshot_changes

DAY = datetime.datetime(2020, 1, 1)
SNAP = "release string, id string, kind string, a string, b string, at timestamp, __hash string, change_kind string"


def snaps(spark, rows):
    return spark.createDataFrame([(*r[:5], DAY + datetime.timedelta(hours=r[5]) if r[5] is not None else None, "h", "c") for r in rows], SNAP)


def changes(spark, rows):
    out = snapshot_changes(snaps(spark, rows), "release", ["id", "kind"], ["a", "b"], ["at"])
    return sorted(tuple(r) for r in out.collect())


def test_changes(spark):
    rows = [
        ("1", "x", "k", "v", None, 1), ("2", "x", "k", "v", None, 1), ("3", "x", "k", "w", None, 1),
        ("1", "gone", "k", "v", "b", 1), ("3", "gone", "k", "v", "b", 1),
        ("2", "new", "k", "v", "b", 1), ("2", "new", "k", "z", "b", 0), ("3", "new", "k", "v", "b", None), ("3", "new", "k", "v", "b", 1),
    ]
    assert changes(spark, rows) == [("2", "gone", "k", "removed"), ("2", "new", "k", "added"), ("3", "gone", "k", "added"), ("3", "x", "k", "changed")]


def test_changes_against_sets(spark):
    rng = random.Random(5)
    rows = [(str(s), f"i{i}", "k", str(rng.randint(0, 2)), None, rng.randint(0, 3)) for s in range(1, 7) for i in range(25) if rng.random() < 0.7]
    held = {(r[0], r[1]): r[3] for r in rows}
    want = []
    for s in range(2, 7):
        was, now = ({i: v for (r, i), v in held.items() if r == str(x)} for x in (s - 1, s))
        want += [(str(s), i, "k", "added") for i in now if i not in was] + [(str(s), i, "k", "removed") for i in was if i not in now]
        want += [(str(s), i, "k", "changed") for i in now if i in was and was[i] != now[i]]
    assert changes(spark, rows) == sorted(want)


def test_a_null_that_moves_is_a_change(spark):
    """A value that moves to the next column, or turns into a null beside one."""
    rows = [("1", "x", "k", None, "v", 1), ("2", "x", "k", "v", None, 1), ("1", "y", "k", "v", None, 1), ("2", "y", "k", None, None, 1), ("1", "z", "k", None, None, 1), ("2", "z", "k", None, None, 2)]
    assert changes(spark, rows) == [("2", "x", "k", "changed"), ("2", "y", "k", "changed")]


@pytest.mark.parametrize("order", [["at"], ["n"], ["day"], ["at", "n"], ["s"]])
def test_last_row_by_any_order(spark, order):
    rows = [("1", "x", "old", 1), ("1", "x", "new", 3), ("1", "x", "mid", 2), ("2", "x", "new", 1), ("1", "y", "a", None), ("1", "y", "b", -5), ("2", "y", "b", None)]
    df = spark.createDataFrame([(*r, DAY + datetime.timedelta(hours=r[3]) if r[3] is not None else None, DAY.date() + datetime.timedelta(days=r[3]) if r[3] is not None else None, None if r[3] is None else f"{r[3] + 9:02d}") for r in rows], "release string, id string, a string, n int, at timestamp, day date, s string")
    assert snapshot_changes(df, "release", ["id"], ["a"], order).count() == 0


def test_changes_of_nothing(spark):
    assert changes(spark, [("1", "x", "k", "v", None, 1), (None, "x", "k", "v", None, 1), ("1", None, "k", None, None, 1)]) == []
    assert snapshot_changes(snaps(spark, [("1", "x", "k", "v", None, 1)]).limit(0), "release", ["id", "kind"], ["a", "b"], ["at"]).count() == 0


HIST = "snap date, id string, a string, b string, at timestamp, valid_from string, __i int"


def history(spark, rows):
    data = [(datetime.date(2020, r[0], 1), *r[1:4], DAY + datetime.timedelta(hours=r[4]), "x", 1) for r in rows]
    out = validity_history(spark.createDataFrame(data, HIST), "snap", "id", ["a", "b"], ["at"])
    return sorted((r["id"], r["valid_from"].month, r["valid_to"].month if r["valid_to"] else 0, r["a"], r["b"]) for r in out.collect())


def test_versions(spark):
    rows = [
        (1, "x", "p", "q", 1), (2, "x", None, "q", 1), (3, "x", "p", "r", 1), (3, "x", "p", "z", 0), (5, "x", "p", "r", 1),
        (1, "y", "s", None, 1), (2, "y", "s", "t", 1), (3, "o", "a", "b", 1), (4, "o", "a", "b", 1), (4, "o", "a", "b", 1), (5, "o", None, None, 1),
    ]
    assert history(spark, rows) == [
        ("o", 3, 0, "a", "b"),
        ("x", 1, 3, "p", "q"),
        ("x", 3, 4, "p", "r"),
        ("x", 5, 0, "p", "r"),
        ("y", 1, 2, "s", None),
        ("y", 2, 3, "s", "t"),
    ]


def test_versions_of_nothing(spark):
    df = spark.createDataFrame([(None, "x", "p", "q", DAY, "x", 1), (datetime.date(2020, 1, 1), None, "p", "q", DAY, "x", 1)], HIST)
    assert validity_history(df, "snap", "id", ["a", "b"], ["at"]).count() == 0
    assert validity_history(df.limit(0), "snap", "id", ["a", "b"], ["at"]).count() == 0


def test_versions_against_loop(spark):
    rng = random.Random(9)
    rows = [(m, f"i{i}", rng.choice(["u", "v", None]) if m > 1 else "u", "w", 1) for m in range(1, 9) for i in range(20) if m == 1 or rng.random() < 0.8]
    by = {(i, m): a for m, i, a, *_ in rows}
    want = []
    for i in {r[1] for r in rows}:
        value, start = None, None
        for m in range(1, 9):
            here = (i, m) in by
            new = (by[i, m] or value) if here else None
            if start and (not here or new != current):
                want.append((i, start, m, current, "w"))
                start = None
            if here and not start:
                start, current = m, new
            value = new if here else value
        if start:
            want.append((i, start, 0, current, "w"))
    assert history(spark, rows) == sorted(want)
