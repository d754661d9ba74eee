import datetime
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.operators import records as R
from lodestack.queries.core_pipeline import EXTRACT

HEADER = list(EXTRACT)
GOOD = ["010001", "A Hospital", "AL", "READM-30-HF-HRRP", "1,360", "", "1.0123", "10.5", "9.5%", "N/A", "07/01/2020", "06/30/2023"]


def plain(line, delimiter):
    """Fields of a record read one character after another; None if its quoting is broken."""
    fields, current, state = [], "", "start"
    for ch in line:
        if state == "start" and ch == '"':
            state = "quoted"
        elif state in ("start", "plain", "closing") and ch == delimiter:
            fields.append(current)
            current, state = "", "start"
        elif state == "closing" and ch == '"':
            current, state = current + '"', "quoted"
        elif state == "closing":
            return None
        elif state == "quoted" and ch == '"':
            state = "closing"
        else:
            current, state = current + ch, "quoted" if state == "quoted" else "plain"
    return None if state == "quoted" else [*fields, current]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet='a",\t\né', max_size=14), st.booleans()), max_size=12))
def test_tokenizer_equals_plain_one(lines):
    texts, tabs = [t for t, _ in lines], np.array([b for _, b in lines], bool)
    broken, fields, starts, breaks = R.tokenize(pa.array(texts, pa.string()), tabs)
    want = [plain(t, "\t" if b else ",") for t, b in lines]
    assert [None if b else f for b, f in zip(broken, fields.to_pylist())] == want
    for text, tab, row, at, broke in zip(texts, tabs, want, starts.to_pylist(), breaks):
        data, delimiter = text.encode(), "\t" if tab else ","
        if row is None:
            # What is before the place can be read, and what is up to it and one more cannot be put right.
            assert at == [] and data[broke:] and (data[broke : broke + 1] == b'"' or plain(data[:broke].decode(), delimiter) is not None)
        else:
            assert broke == len(data) and len(at) == len(row) and at[0] == 0
            assert [plain(data[a : b - 1].decode(), delimiter) for a, b in zip(at, [*at[1:], len(data) + 1])] == [[f] for f in row]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_chunks_compose(classes, chunk):
    state, want = R.START, []
    for c in classes:
        want.append(state)
        state = int(R.NEXT[state, c])
    assert R.states_before(np.array(classes, np.int8), chunk).tolist() == want


def frame(spark, files):
    rows, i = [], 0
    for name, lines in files.items():
        for n, line in enumerate(lines, 1):
            i += 1
            rows.append((i, name, n, line, "x", "y"))
    return spark.createDataFrame(rows, "line_id long, file_name string, line_no int, line string, reason string, fields string")


def with_value(column, value):
    out = list(GOOD)
    out[HEADER.index(column)] = value
    return out


def reasons(spark, files):
    found = R.rejected(R.read_records(frame(spark, files), EXTRACT, ["line_id"]), ["line_id"])
    return {r["line_id"]: r["reason"] for r in found.collect()}


def quoted(fields, delimiter=","):
    return delimiter.join('"' + f.replace('"', '""') + '"' for f in fields)


def test_reasons(spark):
    csv = ["﻿Title", "", quoted(HEADER), quoted(GOOD), ",".join(GOOD[:4]), '"010001,x', quoted(GOOD).replace('"AL"', '"AL"x')]
    order = list(reversed(range(12)))
    tab = ["\t".join(HEADER[i] for i in order), "\t".join(GOOD[i] for i in order), "\t".join(with_value("Start Date", "13/01/2021")[i] for i in order), ""]
    got = reasons(spark, {"a.csv": csv, "b.txt": tab, "none.csv": [quoted(GOOD)]})
    assert got == {5: "column_count", 6: "quoting", 7: "quoting", 10: "invalid_value", 11: "column_count", 12: "no_header"}


def test_offsets(spark):
    """The byte at which a record fails, é having two."""
    fields = with_value("Facility Name", "é")
    lines = [
        ",".join(HEADER), ",".join(with_value("Number of Discharges", "x")).replace("A Hospital", "é"), ",".join([*(f.replace(",", "") for f in fields), "more", "x"]), "a,b", 'a,"b', 'a,"é"x,"y', ",".join(f.replace(",", "") for f in fields),
        ",".join(f.replace(",", "") for f in with_value("Facility ID", "")).replace("07/01/2020", "7"),
    ]
    found = R.rejected(R.read_records(frame(spark, {"a.csv": lines, "b.csv": ["x"]}), EXTRACT, ["line_id"]), ["line_id"])
    good = ",".join(f.replace(",", "") for f in fields).encode()
    assert {r["line_id"]: (r["reason"], r["offset"]) for r in found.collect()} == {
        2: ("invalid_value", lines[1].encode().index(b",x,") + 1), 3: ("column_count", len(good) + 1), 4: ("column_count", 3), 5: ("quoting", 2), 6: ("quoting", 6), 8: ("invalid_value", 0), 9: ("no_header", None),
    }


def test_no_line_is_lost(spark):
    """A file without a header, and lines without a file or a number, are rejected, not dropped."""
    files = {"a.csv": [quoted(HEADER), quoted(GOOD)], "b.csv": [quoted(GOOD), "x,y"]}
    for limit in (R.BROADCAST_FILES, 0):
        records = R.read_records(frame(spark, files), EXTRACT, ["line_id"])
        assert {r["line_id"]: r["__reason"] for r in records.collect()} == {2: None, 3: "no_header", 4: "no_header"}, limit


def test_invalid_values(spark):
    bad = [("Number of Discharges", v) for v in ("1,36,", "-7", "12.5", "< 11", "14½", "1e3")]
    bad += [("Excess Readmission Ratio", v) for v in ("-1.0", "1.0.2", "inf", "NaN", "0;98", "1e", "l.03")]
    bad += [("Footnote", v) for v in ("abc", "-1", "O5", "see text", "#7")]
    bad += [("End Date", v) for v in ("", "2021-06-30", "6/31/2022", "02/30/2021", "06/30/20222")]
    bad += [("Facility ID", v) for v in ("", "12345", "01000a", "010-01", "0100011")]
    good = [("Number of Discharges", " 1,360 "), ("Number of Discharges", "."), ("Predicted Readmission Rate", "12"), ("Footnote", "5 - No result."), ("Footnote", "7, 29"), ("Facility Name", 'A "B", C\nD'), ("Facility ID", " 01A000 ")]
    lines = [quoted(HEADER), *[quoted(with_value(*x)) for x in [*bad, *good]]]
    got = reasons(spark, {"a.csv": lines})
    assert got == {i: "invalid_value" for i in range(2, len(bad) + 2)}


def test_loaded_rows(spark):
    df = frame(spark, {"a.csv": [quoted(HEADER), quoted(GOOD)]})
    row = R.loaded(R.read_records(df, EXTRACT, ["line_id"]), EXTRACT, ["line_id"]).first()
    assert (row["number_of_discharges"], row["expected_readmission_rate"], row["number_of_readmissions"], row["footnote"]) == (1360, 9.5, None, None)
    assert row["start_date"] == datetime.date(2020, 7, 1)


def test_nulls_empty_long_and_repeated(spark):
    long = quoted(with_value("Facility Name", "x" * 300_000))
    schema = "line_id long, file_name string, line_no int, line string"
    rows = [(1, "a.csv", 1, quoted(HEADER)), (2, "a.csv", 2, None), (3, "a.csv", 3, long), (3, "a.csv", 3, long), (4, None, 4, "x"), (5, "a.csv", None, "x"), (None, "a.csv", 6, "x")]
    df = spark.createDataFrame(rows, schema)
    out = R.read_records(df, EXTRACT, ["line_id"])
    assert sorted((r["line_id"] or 0, r["__reason"]) for r in out.where("__reason is not null").collect()) == [(0, "column_count"), (2, "column_count"), (4, "no_header"), (5, "no_header")]
    assert out.where("__reason is null").count() == 2
    assert R.read_records(df.limit(0), EXTRACT, ["line_id"]).count() == 0


def test_many_files_are_joined_by_shuffle(spark, monkeypatch):
    files = {"a.csv": [quoted(HEADER), quoted(GOOD), "x"], "b.csv": [quoted(HEADER), "y"]}
    want = reasons(spark, files)
    monkeypatch.setattr(R, "BROADCAST_FILES", 0)
    assert reasons(spark, files) == want


def test_patterns_are_anchored():
    assert re.match(R.COUNT, "1,000") and not re.match(R.COUNT, "1,00") and not re.match(R.COUNT, "1000,000")
