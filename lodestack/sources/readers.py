"""Published files as text tables: delimited files of any layout, files within zips, title lines, and the schema gate."""

from __future__ import annotations

import csv
import fnmatch
import hashlib
import os
import re
import tempfile
import zipfile
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.registry import Source

#: Names of encodings in declarations, and Spark's for them. Spark does not read Windows-1252; its bytes are those of
#: ISO-8859-1 but for 0x80 to 0x9F, which are put right afterwards.
ENCODINGS = {"cp1252": "ISO-8859-1", "utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1"}
C1 = "".join(chr(i) for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "ignore"))
WINDOWS = "".join(bytes([i]).decode("cp1252", "ignore") for i in range(0x80, 0xA0))


class SchemaError(ValueError):
    """A release that lacks what is read later."""


def plain(column: str) -> str:
    return "".join(column.lower().split())


def find_member(path: str | Path, patterns: Sequence[str]) -> str | None:
    """The one file in a zip that fits a pattern, case aside; None if there is none, an error if there are several."""
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if not n.endswith("/") and "__MACOSX/" not in n]
    for pattern in patterns:
        found = [n for n in names if fnmatch.fnmatch(n.lower(), pattern.lower()) or fnmatch.fnmatch(n.rsplit("/", 1)[-1].lower(), pattern.lower())]
        if len(found) > 1:
            raise SchemaError(f"{pattern!r} fits {len(found)} files of {path}: {', '.join(found)}")
        if found:
            return found[0]
    return None


def store_stream(stream: BinaryIO, target: str | Path, size: int = 1 << 20) -> str:
    """Copies a stream to a file that appears only when it is whole; returns its SHA-256."""
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    digest = hashlib.sha256()
    handle, part = tempfile.mkstemp(dir=target.parent, suffix=".part")
    try:
        with os.fdopen(handle, "wb") as out:
            while block := stream.read(size):
                digest.update(block)
                out.write(block)
        os.replace(part, target)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise
    return digest.hexdigest()


def extract(path: str | Path, member: str, folder: str | Path) -> str:
    target = Path(folder) / Path(member).name
    with zipfile.ZipFile(path) as z, z.open(member) as inside:
        store_stream(inside, target)
    return str(target)


def first_line(spark: SparkSession, path: str) -> str:
    """The first line, which for some files is a title; empty for an empty file."""
    rows = spark.read.text(path).limit(1).collect()
    return (rows[0][0] or "").lstrip("﻿").strip() if rows else ""


def read_text_table(spark: SparkSession, path: str, options: Mapping[str, Any] | None = None) -> DataFrame:
    """Every column as text, nothing read as missing: an empty cell is ``''``, since null is a column that a release lacks.

    ``options``: ``sep``, ``encoding``, ``skiprows`` (title lines above the header), ``multiline``. Names lose blanks around
    them; columns without a name are dropped. A file with title lines, or in Windows-1252, is read as lines, of which the
    first are left out by number, and its records are parsed from lines; all of it in parallel.
    """
    options = dict(options or {})
    sep, skip = options.get("sep", ","), int(options.get("skiprows", 0))
    charset = str(options.get("encoding", "utf-8")).lower()
    windows = charset == "cp1252"
    charset = ENCODINGS.get(charset, charset)
    csv_options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if not skip and not windows:
        df = spark.read.options(**csv_options, header=True, inferSchema=False, encoding=charset, multiLine=bool(options.get("multiline", False))).csv(path)
        names = df.columns
    else:
        # The text source keeps bytes as they are, so they can be decoded afterwards.
        lines = spark.read.text(path).withColumn("__at", F.monotonically_increasing_id())
        if charset != "UTF-8":
            lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), charset))
        if windows:
            lines = lines.withColumn("value", F.translate("value", C1, WINDOWS))
        above = lines.orderBy("__at").limit(skip + 1).collect()
        if len(above) <= skip:
            raise SchemaError(f"{path} has no header after {skip} title lines")
        names = next(csv.reader([above[skip]["value"].lstrip("\ufeff")], delimiter=sep))
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        body = lines.where((F.col("__at") > above[skip]["__at"]) & (F.col("value") != ""))
        df = body.select(F.from_csv("value", F.lit(schema), csv_options).alias("r")).select("r.*")
    names = [n.lstrip("\ufeff").strip() for n in names]
    df = df.toDF(*[f"c{i}" for i in range(len(names))]).fillna("")
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n and not re.fullmatch(r"_c[0-9]+", n)])


def validate(df: DataFrame, source: Source, title: str | None = None, expected_title: str | None = None) -> int:
    """The number of rows, if the release has all required columns (case and blanks aside), enough rows and its title."""
    have = {plain(c) for c in df.columns}
    for column in source.required_columns:
        names = (column,) if isinstance(column, str) else column
        if not any(plain(n) in have for n in names):
            raise SchemaError(f"{source.name}: no column {' or '.join(names)}; there are {', '.join(df.columns[:30])}")
    if expected_title and expected_title.lower() not in (title or "").lower():
        raise SchemaError(f"{source.name}: the first line is {title!r}, not {expected_title!r}")
    rows = df.count()
    if rows < source.min_rows:
        raise SchemaError(f"{source.name}: {rows} rows, fewer than {source.min_rows}")
    return rows
