import io
import json
import zipfile

import pytest
from pyspark.sql import types as T

from lodestack import cli
from lodestack.sources.ingest import Downloads, ingest, ingest_summary, with_retries
from lodestack.sources.readers import SchemaError, find_member, first_line, read_text_table, store_stream, validate
from lodestack.sources.registry import Source, SourceError, load_sources, resolve_releases, source_from
from lodestack.sources.store import RawStore
from lodestack.streaming.incremental import append_new, current_periods


class Files:
    """Metadata and files by address."""

    def __init__(self, files, meta=None):
        self.files, self.meta, self.opened = files, meta or {}, []

    def json(self, url):
        return self.meta[url]

    def __call__(self, url):
        self.opened.append(url)
        if url not in self.files:
            raise FileNotFoundError(url)
        return io.BytesIO(self.files[url])


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_registry(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("sources:\n  a:\n    kind: cms_zip\n    read_options: {sep: ','}\n    required_columns: [[Facility ID, Provider ID]]\n    releases:\n      - {release: FY1, url: u, member: m.txt, read_options: {skiprows: 1}}\n")
    source = load_sources(path)["a"]
    assert source.releases[0].read_options == {"sep": ",", "skiprows": 1} and source.required_columns == (("Facility ID", "Provider ID"),)


@pytest.mark.parametrize("spec", [{"kind": "ftp"}, {"kind": "cms_zip"}, {"kind": "cms_zip", "releases": [{"release": "x", "url": "u"}]}, {"kind": "static_file", "release": "x"}, {"kind": "cms_archive", "releases": [{"release": "x", "url": "u"}]}, {"kind": "static_file", "release": "x", "url": "u", "releases": [{}]}, {"kind": "cms_archive", "typo": 1}])
def test_wrong_declarations(spec):
    with pytest.raises(SourceError):
        source_from("s", spec)


def test_release_lookup():
    files = Files({}, {"d": {"modified": "2025-01-02T00", "distribution": [{"downloadURL": "u"}]}, "c": {"rowsUpdatedAt": 86400}, "l": [{"type": "theme", "date": "2", "url": "b"}, {"type": "annual_theme", "date": "0", "url": "x"}, {"type": "theme", "date": "1", "url": "a"}]})
    assert [(r.label, r.url) for r in resolve_releases(Source("s", "cms_provider_data", dataset_id="d"), files)] == [("2025-01-02", "u")]
    assert resolve_releases(Source("s", "cdc_socrata", url="c"), files)[0].label == "1970-01-02"
    assert [r.label for r in resolve_releases(Source("s", "cms_archive", url="l"), files)] == ["1", "2"]


def test_zip_members(tmp_path):
    path = tmp_path / "z.zip"
    path.write_bytes(zipped({"A/Hospital_Data.csv": "x", "__MACOSX/A/Hospital_Data.csv": "x", "b.csv": "y", "c.csv": "z"}))
    assert find_member(path, ["hospital*.csv"]) == "A/Hospital_Data.csv" and find_member(path, ["*.txt"]) is None
    with pytest.raises(SchemaError):
        find_member(path, ["?.csv"])


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def table(df):
    return df.columns, [tuple(r) for r in df.collect()]


def test_layouts(spark, tmp_path):
    plain = write(tmp_path, "a.csv", "﻿Facility ID, Ratio ,\r\n010001,N/A,\r\n,\"1,5\",\r\n".encode())
    assert table(read_text_table(spark, plain)) == (["Facility ID", "Ratio"], [("010001", "N/A"), ("", "1,5")])
    tab = write(tmp_path, "b.txt", b"FY 2020 Final Rule\nHospital CCN\tName\n010001\tDo\xf1a \x96 x\n020002\t\n")
    assert table(read_text_table(spark, tab, {"sep": "\t", "skiprows": 1, "encoding": "cp1252"})) == (["Hospital CCN", "Name"], [("010001", "Doña – x"), ("020002", "")])
    assert first_line(spark, tab) == "FY 2020 Final Rule"
    pipe = write(tmp_path, "c.txt", "﻿A|B\n1|\n".encode())
    assert table(read_text_table(spark, pipe, {"sep": "|", "encoding": "utf-8-sig"})) == (["A", "B"], [("1", "")])


def test_gate(spark):
    df = spark.createDataFrame([("1", "2")], "`provider id` string, Ratio string")
    source = Source("s", "static_file", required_columns=(("Facility ID", "Provider ID"), "ratio"), min_rows=1)
    assert validate(df, source, "FY 2020 rule", "fy 2020") == 1
    for other, title in ((Source("s", "static_file", required_columns=("Name",)), None), (Source("s", "static_file", min_rows=2), None), (source, "FY 2021")):
        with pytest.raises(SchemaError):
            validate(df, other, title, "FY 2020" if title else None)


def test_streams_and_retries(tmp_path):
    target = tmp_path / "x" / "f"
    assert len(store_stream(io.BytesIO(b"abc"), target)) == 64 and target.read_bytes() == b"abc"

    class Broken(io.BytesIO):
        def read(self, n):
            raise OSError

    with pytest.raises(OSError):
        store_stream(Broken(), tmp_path / "y")
    assert not list(tmp_path.glob("*.part")) and not (tmp_path / "y").exists()
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise ConnectionError
        return io.BytesIO(b"ok")

    assert with_retries(flaky, wait=0)("u").read() == b"ok"
    downloads = Downloads(Files({"u": b"1"}), tmp_path)
    assert downloads.get("u") == downloads.get("u") and downloads.open.opened == ["u"]


class Answered(Exception):
    def __init__(self, code, headers=None):
        self.code, self.headers = code, headers or {}


@pytest.mark.parametrize("error,times", [(Answered(503), 3), (Answered(429, {"Retry-After": "0"}), 3), (Answered(404), 1), (TimeoutError(), 3), (ValueError(), 1)])
def test_which_errors_are_tried_again(error, times):
    calls = []

    def failing(url):
        calls.append(url)
        raise error

    with pytest.raises(type(error)):
        with_retries(failing, tries=3, wait=0)("u")
    assert len(calls) == times


def test_records_of_releases(tmp_path):
    """Each release has its own record, so two stores that write at once lose none; what was absent may be stored later."""
    a, b = RawStore(tmp_path / "raw"), RawStore(tmp_path / "raw")
    a.mark_absent("s", "1", {"url": "u"})
    b.mark_absent("s", "2", {"url": "v"})
    assert set(a.manifest()["s"]["absent"]) == {"1", "2"} and a.is_known("s", "2") and not a.has("s", "2") and not a.is_known("s", "3")
    assert a.status() == [{"source": "s", "releases": 0, "absent": 2, "latest": None, "rows": 0}] and RawStore(tmp_path / "none").manifest() == {}


def test_files_by_scheme(spark, tmp_path):
    """The same calls through Hadoop's file systems."""
    from lodestack.sources import files

    for at in (str(tmp_path / "plain"), f"file://{tmp_path}/scheme"):
        files.write_text(f"{at}/a/x.json", "é1")
        files.write_text(f"{at}/a/x.json", "é2")
        assert files.read_text(f"{at}/a/x.json") == "é2" and files.exists(f"{at}/a/x.json") and not files.exists(f"{at}/b") and files.listed(f"{at}/b") == []
        assert [p.rsplit("/", 1)[-1] for p in files.listed(f"{at}/a")] == ["x.json"]


def test_hadoop_files(spark, tmp_path, monkeypatch):
    from lodestack.sources import files

    monkeypatch.setattr(files, "is_remote", lambda path: True)
    at = f"file://{tmp_path}/h"
    files.write_text(f"{at}/a/x.json", "é1")
    files.write_text(f"{at}/a/x.json", "é2")
    assert files.read_text(f"{at}/a/x.json") == "é2" and files.exists(f"{at}/a/x.json") and not files.exists(f"{at}/b") and files.listed(f"{at}/b") == []
    assert [p.rsplit("/", 1)[-1] for p in files.listed(f"{at}/a") if not p.endswith(".crc")] == ["x.json"]


def test_shell_ingests_from_a_mirror(spark, tmp_path, capsys):
    from urllib.parse import quote

    mirror = tmp_path / "mirror"
    mirror.mkdir()
    (mirror / quote("http://x/list", safe="")).write_text(json.dumps([{"type": "theme", "date": "d1", "url": "http://x/1"}]))
    (mirror / quote("http://x/1", safe="")).write_bytes(zipped({"Hospitals.csv": "A\n1\n2\n"}))
    (tmp_path / "sources.yaml").write_text("sources:\n  theme:\n    kind: cms_archive\n    url: http://x/list\n    members: ['hosp*.csv']\n  other:\n    kind: static_file\n    release: 1\n    url: gone\n")
    args = ["ingest", "--raw", str(tmp_path / "raw"), "--sources", str(tmp_path / "sources.yaml"), "--mirror", str(mirror)]
    assert cli.main([*args, "theme"]) == 0 and "1 stored" in capsys.readouterr().out
    assert cli.main(args) == 1 and "failed" in capsys.readouterr().out and not list((tmp_path / "raw" / "_downloads").iterdir())


def test_ingest(spark, tmp_path, capsys):
    sources = {
        "zip": source_from("zip", {"kind": "cms_zip", "releases": [{"release": "2020", "url": "z", "member": "m.csv"}, {"release": "2021", "url": "y", "member": "m.csv"}]}),
        "lost": source_from("lost", {"kind": "static_file", "release": "1", "url": "nowhere"}),
        "theme": source_from("theme", {"kind": "cms_archive", "url": "list", "members": ["hosp*.csv"]}),
    }
    files = Files({"z": zipped({"m.csv": "A,B\n1,\n"}), "y": zipped({"m.csv": "A,C\n2,x\n"}), "t1": zipped({"Hospitals.csv": "A\n1\n"}), "t2": zipped({"other.csv": "A\n1\n"})}, {"list": [{"type": "theme", "date": "d1", "url": "t1"}, {"type": "theme", "date": "d2", "url": "t2"}]})
    store = RawStore(tmp_path / "raw")
    first = {r.source: r for r in ingest(spark, sources, store, files, files)}
    assert first["zip"].stored == ["2020", "2021"] and first["lost"].error and first["theme"].stored == ["d1"] and first["theme"].absent == ["d2"]
    again = ingest(spark, sources, store, files, files)
    assert {r.source: (r.stored, r.skipped) for r in again}["theme"] == ([], ["d1", "d2"]) and "failed" in ingest_summary(again)
    df = store.read(spark, "zip")
    assert sorted((r["A"], r["B"], r["C"], r["_release"]) for r in df.collect()) == [("1", "", None, "2020"), ("2", None, "x", "2021")]
    assert dict(df.dtypes)["_release"] == "string" and store.read_latest(spark, "zip").first()["A"] == "2"
    with pytest.raises(KeyError):
        store.read_latest(spark, "never")
    assert ingest(spark, {"zip": sources["zip"]}, store, files, files, force=True)[0].stored == ["2020", "2021"]
    assert cli.main(["status", "--raw", str(tmp_path / "raw")]) == 0
    assert {s["source"]: s["rows"] for s in json.loads(capsys.readouterr().out)} == {"theme": 1, "zip": 2}


def test_incremental(spark, tmp_path):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("release", "s", "e", "v")])
    put = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run = lambda: append_new(spark, f"{tmp_path}/in", schema, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    put([("r2", "p", "q", "late")], 1)
    run()
    put([("r1", "p", "q", "early"), ("r3", "x", "y", "other")], 2)
    run()
    run()
    got = current_periods(spark, f"{tmp_path}/t", "release", "s", "e")
    assert sorted(r["v"] for r in got.collect()) == ["late", "other"] and spark.read.parquet(f"{tmp_path}/t").count() == 3
