import json

from lodestack.operators import drift

SCHEMA = "source string, feed_id bigint, release_label string, line_no int, payload string, field string, kind string, n int"


def frame(spark, files):
    rows = []
    for (source, feed, label), payloads in files.items():
        rows += [(source, feed, label, i, p if p is None or isinstance(p, str) else json.dumps(p), "a", "b", 1) for i, p in enumerate(payloads, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def hospital(i, **fields):
    return {"Facility ID": f"01{i:04d}", **{k: v(i) if callable(v) else v for k, v in fields.items()}}


def changes(spark, files):
    return sorted((r["release_label"], r["change_kind"], r["field_before"], r["field_after"]) for r in drift.schema_changes(frame(spark, files)).collect())


def test_kinds_of_change(spark):
    first = [{"Provider ID": f"01{i:04d}", "Score": str(i * 7), "Old": f"o{i}", "Flag": "Yes"} for i in range(12)]
    second = [{"Facility ID": i + 10000, "Linear Score": i * 7.0, "New": f"n{i}", "Flag": True} for i in range(4, 16)]
    got = changes(spark, {("s", 1, "2020-01-01"): first, ("s", 1, "2020-02-01"): second})
    assert got == [
        ("2020-02-01", "added", "", "New"),
        ("2020-02-01", "removed", "Old", ""),
        ("2020-02-01", "renamed", "Provider ID", "Facility ID"),
        ("2020-02-01", "renamed", "Score", "Linear Score"),
        ("2020-02-01", "type_changed", "Flag", "Flag"),
    ]


def test_types(spark):
    def of(value):
        return [hospital(i, V=value) for i in range(3)]

    files = {("s", 1, f"2020-01-0{i}"): of(v) for i, v in enumerate(["7", 7, 7.5, True, "N/A", None, 8], 1)}
    kinds = [(label[-1], kind) for label, kind, *_ in changes(spark, files)]
    # Markers and nulls have no type, so neither entering nor leaving them is a change.
    assert kinds == [("2", "type_changed"), ("3", "type_changed"), ("4", "type_changed")]


def test_text_wins_over_numbers(spark):
    files = {("s", 1, "1"): [hospital(1, V=1.0), hospital(2, V="1")], ("s", 1, "2"): [hospital(1, V="1")]}
    assert changes(spark, files) == []


def test_exact_spelling_and_feeds_apart(spark):
    files = {("s", 1, "1"): [hospital(i, State="AL") for i in range(4)], ("s", 1, "2"): [hospital(i, STATE="AL") for i in range(4)], ("s", 2, "2"): [hospital(1, Other=1)], ("t", 1, "3"): [hospital(1)]}
    assert changes(spark, files) == [("2", "renamed", "State", "STATE")]


def test_values_mostly_change(spark):
    files = {("s", 1, "1"): [hospital(i, A=f"a{i}") for i in range(10)], ("s", 1, "2"): [hospital(i, B=f"a{i}" if i < 4 else f"b{i}") for i in range(10)]}
    assert [c[1] for c in changes(spark, files)] == ["added", "removed"]


def test_many_rows_of_a_hospital(spark):
    """All values of a hospital count, not one of them: here the largest stays, but most others change."""
    of = lambda field, mark: [{"Facility ID": f"01{i:04d}", field: "zz" if j == 0 else f"{mark}{i}{j}"} for i in range(4) for j in range(6)]
    assert [c[1] for c in changes(spark, {("s", 1, "1"): of("A", "a"), ("s", 1, "2"): of("B", "b")})] == ["added", "removed"]
    assert [c[1] for c in changes(spark, {("s", 1, "1"): of("A", "a"), ("s", 1, "2"): of("B", "a") * 2})] == ["renamed"]


def test_the_way_without_broadcast(spark, monkeypatch):
    files = {("s", 1, "1"): [hospital(i, State="AL") for i in range(4)], ("s", 1, "2"): [hospital(i, STATE="AL") for i in range(4)]}
    monkeypatch.setattr(drift, "BROADCAST_STEPS", 0)
    assert changes(spark, files) == [("2", "renamed", "State", "STATE")]


def test_versions_and_recorded_steps(spark):
    files = {("s", 1, str(i)): [hospital(1, V=v, **more)] for i, (v, more) in enumerate([("a", {}), ("b", {}), (1, {}), (2, {"W": 1}), ("c", {"W": 2})])}
    steps = drift.recorded_steps(frame(spark, files)).orderBy("release_label", "step").collect()
    assert [(r["release_label"], r["version_before"], r["schema_version"], r["step"], r["change_kind"], r["type_before"], r["type_after"]) for r in steps] == [
        ("2", 1, 2, 1, "type_changed", "text", "integer"), ("3", 2, 3, 1, "added", None, "integer"), ("4", 3, 4, 1, "type_changed", "integer", "text"),
    ]
    assert len({r["fingerprint"] for r in steps}) == 3


def test_nulls_broken_repeated_and_empty(spark):
    files = {("s", 1, "1"): [hospital(1, A="x"), hospital(1, A="x"), None, "not json", "[1]"], ("s", 1, "2"): [None], (None, 1, "1"): [hospital(1)], ("s", None, "1"): [hospital(1)], ("s", 1, None): [hospital(1)]}
    assert changes(spark, files) == [("2", "removed", "A", ""), ("2", "removed", "Facility ID", "")]
    assert drift.schema_changes(frame(spark, {("s", 1, "1"): [None]}).limit(0)).count() == 0


def test_consistent_table(spark):
    first = [{"Provider ID": "10001", "Strange": f"s{i}", "ERR": "1.5", "Footnote": "", "Late Flag": "No"} for i in (1,)]
    second = [{"Facility ID": "010001", "Excess Readm Ratio": "x", "Strange": "s", "Late Flag": True, "Discharges": "1,360"}]
    rows = drift.consistent_table(frame(spark, {("s", 1, "1"): first, ("s", 1, "2"): second})).orderBy("release_label").collect()
    assert [r["facility_id"] for r in rows] == ["010001", "010001"]
    assert [r["excess_readmission_ratio"] for r in rows] == [1.5, None]
    assert [r["reported_late"] for r in rows] == [False, True] and rows[1]["discharges"] == 1360
    assert json.loads(rows[1]["other_fields"]) == {"Strange": "s", "excess_readmission_ratio": "x"}
    assert [r["schema_version"] for r in rows] == [1, 2] and rows[0]["fingerprint"] != rows[1]["fingerprint"]


def test_concepts_follow_renames(spark):
    first = [hospital(i, Discharges=str(100 + i)) for i in range(5)]
    second = [{"Facility ID": f"01{i:04d}", "Cases Seen": str(100 + i)} for i in range(5)]
    rows = drift.consistent_table(frame(spark, {("s", 1, "1"): first, ("s", 1, "2"): second})).where("release_label = '2'").collect()
    assert sorted(r["discharges"] for r in rows) == [100, 101, 102, 103, 104]
