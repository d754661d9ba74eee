"""Sources declared in YAML, and how to find their releases."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any, Protocol

import yaml

#: The kinds of source, by how their releases are found.
KINDS = ("cms_provider_data", "cms_archive", "cms_zip", "cdc_socrata", "static_file")


class SourceError(ValueError):
    """A source that is declared wrongly."""


@dataclass(frozen=True)
class Release:
    """One immutable version of a source."""

    label: str
    url: str
    member: str | None = None
    read_options: Mapping[str, Any] = field(default_factory=dict)
    title: str | None = None


@dataclass(frozen=True)
class Source:
    """``required_columns``: a name, or a list of names of which one must be there. ``members``: globs for a file in a zip."""

    name: str
    kind: str
    description: str = ""
    dataset_id: str | None = None
    url: str | None = None
    required_columns: tuple = ()
    min_rows: int = 1
    releases: tuple[Release, ...] = ()
    members: tuple[str, ...] = ()
    read_options: Mapping[str, Any] = field(default_factory=dict)


def source_from(name: str, spec: Mapping[str, Any]) -> Source:
    """Rejects unknown kinds and keys, fixed releases where they are looked up, and missing ones where they are fixed."""
    kind = spec.get("kind")
    if kind not in KINDS:
        raise SourceError(f"{name}: no kind {kind!r}; there are {', '.join(KINDS)}")
    unknown = set(spec) - {"kind", "description", "dataset_id", "url", "required_columns", "min_rows", "releases", "members", "read_options", "theme", "release"}
    if unknown:
        raise SourceError(f"{name}: unknown keys {', '.join(sorted(unknown))}")
    fixed = kind in ("cms_zip", "static_file")
    listed = list(spec.get("releases") or [])
    if "release" in spec:
        if listed:
            raise SourceError(f"{name}: a single release and a list of releases")
        listed = [{"release": spec["release"], "url": spec.get("url")}]
    if bool(listed) != fixed:
        raise SourceError(f"{name}: releases of {kind} are {'fixed, but none is given' if fixed else 'looked up, not fixed'}")
    options = dict(spec.get("read_options") or {})
    releases = []
    for one in listed:
        if not one.get("url") or "release" not in one:
            raise SourceError(f"{name}: a release needs a label and a url")
        if kind == "cms_zip" and not one.get("member"):
            raise SourceError(f"{name}: {one['release']} names no file in its zip")
        releases.append(Release(str(one["release"]), one["url"], one.get("member"), options | dict(one.get("read_options") or {}), one.get("title")))
    required = tuple(tuple(c) if isinstance(c, list) else c for c in spec.get("required_columns") or ())
    return Source(name, kind, spec.get("description", ""), spec.get("dataset_id"), spec.get("url"), required, int(spec.get("min_rows", 1)), tuple(releases), tuple(spec.get("members") or ()), options)


def load_sources(path: str | Path) -> dict[str, Source]:
    declared = yaml.safe_load(Path(path).read_text()) or {}
    return {name: source_from(name, spec) for name, spec in (declared.get("sources") or {}).items()}


class Lookup(Protocol):
    """Where metadata come from: a web service, or a folder in tests."""

    def json(self, url: str) -> Any: ...


def resolve_releases(source: Source, lookup: Lookup) -> list[Release]:
    """The releases that a source has now, the oldest first."""
    if source.releases:
        return list(source.releases)
    found = lookup.json(source.url or source.dataset_id)
    if source.kind == "cms_provider_data":
        return [Release(found["modified"][:10], found["distribution"][0]["downloadURL"], read_options=source.read_options)]
    if source.kind == "cdc_socrata":
        day = datetime.fromtimestamp(int(found["rowsUpdatedAt"]), UTC).date().isoformat()
        return [Release(day, f"{source.url}/rows.csv", read_options=source.read_options)]
    # An archive lists bundles of a whole year beside the snapshots of a theme; only the latter are releases.
    themes = [x for x in found if x.get("type") == "theme"]
    return [Release(x["date"], x["url"], read_options=source.read_options) for x in sorted(themes, key=lambda x: x["date"])]
