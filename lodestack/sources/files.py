"""Small files on any file system: plain paths on this machine, addresses with a scheme through Hadoop's file systems."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def _hadoop(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"{path} needs a Spark session")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _plain(path: str) -> Path:
    return Path(path.removeprefix("file://"))


def exists(path: str) -> bool:
    if is_remote(path):
        _, at, files = _hadoop(path)
        return files.exists(at)
    return _plain(path).exists()


def read_text(path: str) -> str:
    if is_remote(path):
        jvm, at, files = _hadoop(path)
        stream = files.open(at)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
    return _plain(path).read_text()


def write_text(path: str, text: str) -> None:
    """The file appears whole or not at all."""
    if is_remote(path):
        jvm, at, files = _hadoop(path)
        part = at.suffix(".part")
        stream = files.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        files.delete(at, False)
        files.rename(part, at)
        return
    target = _plain(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=target.parent, suffix=".part")
    with os.fdopen(handle, "w") as out:
        out.write(text)
    os.replace(part, target)


def listed(folder: str) -> list[str]:
    """Paths directly in a folder; none if there is no such folder."""
    if is_remote(folder):
        _, at, files = _hadoop(folder)
        return sorted(s.getPath().toString() for s in files.listStatus(at)) if files.exists(at) else []
    at = _plain(folder)
    return sorted(str(p) for p in at.iterdir()) if at.is_dir() else []
