"""Ingestion: releases that are not stored yet are fetched, checked and written; a failing source stops no other."""

from __future__ import annotations

import json
import shutil
import tempfile
import time
import zipfile
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, BinaryIO
from urllib.error import URLError
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession

from lodestack.sources.files import is_remote
from lodestack.sources.readers import extract, find_member, first_line, read_text_table, store_stream, validate
from lodestack.sources.registry import Lookup, Release, Source, resolve_releases
from lodestack.sources.store import RawStore

Opener = Callable[[str], BinaryIO]


@dataclass
class Result:
    source: str
    stored: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    absent: list[str] = field(default_factory=list)
    error: str | None = None


#: Answers of a server that may be another the next time.
TEMPORARY = frozenset({408, 429, 500, 502, 503, 504})


def may_pass(error: Exception) -> bool:
    """Whether an error is worth another try: broken connections, time-outs and temporary answers, but no lasting answer such as 404."""
    status = getattr(error, "code", None) or getattr(error, "status", None)
    if isinstance(status, int):
        return status in TEMPORARY
    return isinstance(error, (ConnectionError, TimeoutError, URLError))


def with_retries(open_: Opener, tries: int = 4, wait: float = 0.5, longest: float = 60.0) -> Opener:
    """Tries again on errors that may pass, waiting twice as long each time, or as long as the server asks."""

    def opened(url: str) -> BinaryIO:
        for attempt in range(1, tries + 1):
            try:
                return open_(url)
            except Exception as error:  # noqa: BLE001
                if attempt == tries or not may_pass(error):
                    raise
                asked = (getattr(error, "headers", None) or {}).get("Retry-After", "")
                time.sleep(min(longest, float(asked) if asked.isdigit() else wait * 2 ** (attempt - 1)))
        raise AssertionError

    return opened


class Web:
    """Files and metadata from the web, by the standard library."""

    def __init__(self, timeout: float = 60.0, agent: str = "lodestack") -> None:
        self.timeout, self.agent = timeout, agent

    def open(self, url: str) -> BinaryIO:
        return urlopen(Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout)  # noqa: S310

    __call__ = open

    def json(self, url: str) -> Any:
        with with_retries(self.open)(url) as answer:
            return json.load(answer)


class Downloads:
    """Each address is fetched once per run, whoever asks."""

    def __init__(self, open_: Opener, folder: str | Path) -> None:
        self.open, self.folder, self.done = open_, Path(folder), {}

    def get(self, url: str) -> tuple[str, str]:
        if url not in self.done:
            target = self.folder / f"{len(self.done)}-{url.rsplit('/', 1)[-1] or 'file'}"
            with self.open(url) as stream:
                self.done[url] = (str(target), store_stream(stream, target))
        return self.done[url]


def _ingest_release(spark: SparkSession, source: Source, release: Release, store: RawStore, downloads: Downloads) -> bool:
    path, digest = downloads.get(release.url)
    record = {"url": release.url, "sha256": digest}
    if zipfile.is_zipfile(path):
        member = release.member or find_member(path, source.members or ("*.csv",))
        if member is None:
            store.mark_absent(source.name, release.label, record)
            return False
        record["member"] = member
        path = extract(path, member, Path(path).parent / f"{source.name}-{release.label}")
    options = dict(source.read_options) | dict(release.read_options)
    df = read_text_table(spark, path, options)
    validate(df, source, first_line(spark, path) if release.title else None, release.title)
    store.write(df, source.name, release.label, record)
    return True


def _working_folder(spark: SparkSession, store: RawStore, shared: str | None) -> str:
    """Where downloads are kept until they are stored. Executors read them there, so on a cluster it lies where all of them see it: in
    ``shared``, else in the store, which must then be a mounted folder."""
    if shared is None and not is_remote(store.folder):
        shared = f"{store.folder}/_downloads"
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a mounted folder for downloads that all executors share")
    if shared is not None:
        Path(shared).mkdir(parents=True, exist_ok=True)
    return tempfile.mkdtemp(dir=shared)


def ingest(spark: SparkSession, sources: Mapping[str, Source], store: RawStore, lookup: Lookup, open_: Opener, force: bool = False, shared: str | None = None) -> list[Result]:
    """What is new of all sources. ``shared``: a folder for downloads that all executors see; they are deleted at the end."""
    results = []
    folder = _working_folder(spark, store, shared)
    try:
        downloads = Downloads(with_retries(open_), folder)
        for source in sources.values():
            result = Result(source.name)
            results.append(result)
            try:
                for release in resolve_releases(source, lookup):
                    if not force and store.is_known(source.name, release.label):
                        result.skipped.append(release.label)
                        continue
                    (result.stored if _ingest_release(spark, source, release, store, downloads) else result.absent).append(release.label)
            except Exception as error:  # noqa: BLE001
                result.error = f"{type(error).__name__}: {error}"
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return results


def ingest_summary(results: list[Result]) -> str:
    lines = [f"{r.source}: {len(r.stored)} stored, {len(r.skipped)} known, {len(r.absent)} absent" + (f"; failed: {r.error}" if r.error else "") for r in results]
    return "\n".join(lines)
