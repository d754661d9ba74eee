"""Named tables built in the order of what they need, materialized by layer, and checked before what depends on them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from lodestack.checks import Outcome, Suite

Build = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Node:
    """``build`` gets the needed tables by name. Tables are written, views stay plans. Writing also makes strict casts
    fail at their table: a lazy plan would skip a bad cast in a column nobody reads."""

    name: str
    build: Build
    needs: tuple[str, ...] = ()
    layer: str = "staging"
    view: bool = False


@dataclass
class Pipeline:
    nodes: dict[str, Node] = field(default_factory=dict)
    checks: dict[str, list[Callable[[Suite, Mapping[str, DataFrame]], None]]] = field(default_factory=dict)

    def add(self, node: Node) -> None:
        self.nodes[node.name] = node

    def node(self, *needs: str, layer: str = "staging", view: bool = False) -> Callable[[Build], Build]:
        """Decorator: registers a function under its own name."""

        def register(build: Build) -> Build:
            self.add(Node(build.__name__, build, needs, layer, view))
            return build

        return register

    def check(self, table: str) -> Callable:
        def register(rule: Callable[[Suite, Mapping[str, DataFrame]], None]) -> Callable:
            self.checks.setdefault(table, []).append(rule)
            return rule

        return register

    def order(self, wanted: list[str] | None = None) -> list[str]:
        """Names of the nodes to build, each after what it needs."""
        graph = {n: [d for d in node.needs if d in self.nodes] for n, node in self.nodes.items()}
        if wanted is not None:
            keep: set[str] = set()
            todo = list(wanted)
            while todo:
                name = todo.pop()
                if name not in keep:
                    keep.add(name)
                    todo += graph[name]
            graph = {n: graph[n] for n in keep}
        return list(TopologicalSorter(graph).static_order())

    def plan(self, sources: Mapping[str, DataFrame], wanted: list[str] | None = None) -> dict[str, DataFrame]:
        """All tables as plans, nothing written."""
        tables = dict(sources)
        for name in self.order(wanted):
            tables[name] = self.nodes[name].build(tables)
        return tables

    def run(self, spark: SparkSession, sources: Mapping[str, DataFrame], folder: str, wanted: list[str] | None = None) -> tuple[dict[str, DataFrame], list[Outcome], list[str]]:
        """Builds, writes and checks. Returns the tables, the outcomes of checks, and what was skipped because an
        ``error`` check failed on something it needs. Failing rows are written under ``audit``."""
        tables, outcomes, skipped, broken = dict(sources), [], [], set()
        for name in self.order(wanted):
            node = self.nodes[name]
            if broken & set(node.needs):
                broken.add(name)
                skipped.append(name)
                continue
            made = node.build(tables)
            if not node.view:
                path = f"{folder}/{node.layer}/{name}"
                made.write.mode("overwrite").parquet(path)
                made = spark.read.parquet(path)
            tables[name] = made
            suite = Suite()
            for rule in self.checks.get(name, []):
                rule(suite, tables)
            found = suite.run(f"{folder}/audit")
            outcomes += found
            if any(not o.passed and o.severity == "error" for o in found):
                broken.add(name)
        return tables, outcomes, skipped
