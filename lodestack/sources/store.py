"""The raw layer: one Parquet folder per source and release, and a manifest of what is stored."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources import files


class RawStore:
    """``folder`` may lie on any file system that Spark reads. Each release has a record of its own, so runs beside one another lose none."""

    def __init__(self, folder: str | Path) -> None:
        self.folder = str(folder).rstrip("/")

    def path_of(self, source: str, release: str) -> str:
        return f"{self.folder}/{source}/_release={release}"

    def _record_path(self, source: str, release: str) -> str:
        return f"{self.folder}/_manifest/{source}/{release}.json"

    def manifest(self) -> dict:
        """Of each source its stored ``releases``, the ``absent`` ones and the ``latest`` stored, put together from the records."""
        out: dict = {}
        for folder in files.listed(f"{self.folder}/_manifest"):
            source = folder.rstrip("/").rsplit("/", 1)[-1]
            for path in files.listed(folder):
                if path.endswith(".json"):
                    kind, record = (loaded := json.loads(files.read_text(path)))["kind"], loaded["record"]
                    out.setdefault(source, {}).setdefault(kind, {})[path.rsplit("/", 1)[-1].removesuffix(".json")] = record
            if out.get(source, {}).get("releases"):
                out[source]["latest"] = max(out[source]["releases"])
        return out

    def _save(self, source: str, release: str, kind: str, record: Mapping) -> None:
        files.write_text(self._record_path(source, release), json.dumps({"kind": kind, "record": dict(record)}, indent=1, sort_keys=True))

    def has(self, source: str, release: str) -> bool:
        return self._kind(source, release) == "releases" and files.exists(self.path_of(source, release))

    def _kind(self, source: str, release: str) -> str | None:
        path = self._record_path(source, release)
        return json.loads(files.read_text(path))["kind"] if files.exists(path) else None

    def is_known(self, source: str, release: str) -> bool:
        """Stored, or looked for and found absent."""
        return self.has(source, release) or self._kind(source, release) == "absent"

    def mark_absent(self, source: str, release: str, record: Mapping) -> None:
        self._save(source, release, "absent", record)

    def write(self, df: DataFrame, source: str, release: str, record: Mapping) -> int:
        """Adds lineage columns and writes the release; Spark's committer makes it appear at once. Returns its rows."""
        stamped = df.withColumns({"_source": F.lit(source), "_ingested_at": F.lit(datetime.now(UTC).isoformat(timespec="seconds"))})
        path = self.path_of(source, release)
        stamped.write.mode("overwrite").parquet(path)
        rows = df.sparkSession.read.parquet(path).count()
        self._save(source, release, "releases", {**record, "rows": rows, "ingested_at": datetime.now(UTC).isoformat(timespec="seconds")})
        return rows

    def read(self, spark: SparkSession, source: str) -> DataFrame:
        """All releases by name; ``_release`` is a partition and stays text, so a filter on it prunes folders."""
        before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        try:
            return spark.read.option("mergeSchema", True).option("basePath", f"{self.folder}/{source}").parquet(f"{self.folder}/{source}")
        finally:
            spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", before)

    def read_latest(self, spark: SparkSession, source: str) -> DataFrame:
        entry = self.manifest().get(source, {})
        if "latest" not in entry:
            raise KeyError(f"{source} was never ingested")
        return spark.read.parquet(self.path_of(source, entry["latest"])).withColumn("_release", F.lit(entry["latest"]))

    def status(self) -> list[dict]:
        return [
            {"source": s, "releases": len(e.get("releases", {})), "absent": len(e.get("absent", {})), "latest": e.get("latest"), "rows": sum(r["rows"] for r in e.get("releases", {}).values())}
            for s, e in sorted(self.manifest().items())
        ]
