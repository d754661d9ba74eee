"""A metric layer: measures, dimensions and joins are declared once; requests become one DataFrame."""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.relations import ordered

MOST_ROWS = 500
OPERATORS: dict[str, Callable] = {
    "=": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
}


class RequestError(ValueError):
    """A request for what the layer does not offer."""


@dataclass(frozen=True)
class Model:
    """A table: its grain, what it can be joined to, and what it offers.

    ``key``: the column by which other models' ``joins`` (entity to column) reach it. ``prefix`` names the entity in
    dimensions. ``dimensions`` map a name to a column expression; ``shared`` ones are known without a prefix.
    """

    name: str
    table: str
    prefix: str
    key: str | None = None
    joins: Mapping[str, str] = field(default_factory=dict)
    dimensions: Mapping[str, str] = field(default_factory=dict)
    shared: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Measure:
    model: str
    how: str
    expression: str

    def column(self) -> Column:
        makes = {"sum": F.sum, "max": F.max, "average": F.avg, "count": F.count}
        return makes[self.how](F.expr(self.expression))


#: How figures are written, by the form that a metric declares.
FORMS = {"count": "{:,.0f}", "share": "{:.1%}", "percent": "{:.2f}%", "ratio": "{:.4f}", "score": "{:.1f}"}


@dataclass(frozen=True)
class Metric:
    """Simple (one measure) or a ratio of two metrics, null where the denominator is 0 or missing."""

    name: str
    label: str
    measure: Measure | None = None
    ratio: tuple[str, str] | None = None
    hidden: bool = False
    form: str = "count"

    def show(self, value: float | None) -> str:
        return "n/a" if value is None or value != value else FORMS[self.form].format(value)


@dataclass(frozen=True)
class Filter:
    """``op`` is one of ``OPERATORS``, or ``in`` with a tuple of values."""

    dimension: str
    op: str
    value: object

    def holds(self) -> Column:
        here = F.col(self.dimension)
        return here.isin(*self.value) if self.op == "in" else OPERATORS[self.op](here, F.lit(self.value))


class MetricLayer:
    def __init__(self, models: Sequence[Model], metrics: Sequence[Metric], tables: Callable[[str], DataFrame]) -> None:
        self.models = {m.name: m for m in models}
        self.by_entity = {m.prefix: m for m in models if m.key}
        self.all_metrics = {m.name: m for m in metrics}
        self.tables = tables

    # What is offered

    @cached_property
    def metrics(self) -> dict[str, Metric]:
        return {n: m for n, m in self.all_metrics.items() if not m.hidden}

    def _leaves(self, name: str) -> list[str]:
        """The simple metrics that a metric is made of."""
        metric = self.all_metrics[name]
        return [name] if metric.measure else list(dict.fromkeys(x for part in metric.ratio for x in self._leaves(part)))

    def _reach(self, model: Model, path: tuple[str, ...] = ()) -> dict[str, tuple[tuple[str, ...], str]]:
        """Dimension names from a model on, with the entities to go through and the expression."""
        out = {"__".join([*(path or (model.prefix,)), n]): (path, e) for n, e in model.dimensions.items()}
        if not path:
            out |= {n: (path, e) for n, e in model.shared.items()}
        for entity in model.joins:
            if entity in self.by_entity and entity not in path:
                out |= self._reach(self.by_entity[entity], (*path, entity))
        return out

    def dimensions_of(self, metrics: Sequence[str]) -> list[str]:
        """Dimensions that all metrics share."""
        sets = [set(self._reach(self.models[self.all_metrics[leaf].measure.model])) for m in metrics for leaf in self._leaves(m)]
        return sorted(set.intersection(*sets)) if sets else []

    def describe(self) -> list[dict]:
        return [{"name": m.name, "label": m.label, "dimensions": self.dimensions_of([m.name])} for m in self.metrics.values()]

    def validate(self, metrics: Sequence[str], group_by: Sequence[str] = (), filters: Sequence[Filter] = (), order_by: Sequence[str] = (), limit: int | None = None) -> None:
        if not metrics:
            raise RequestError("a request needs a metric")
        for m in metrics:
            if m not in self.metrics:
                raise RequestError(f"no metric {m!r}; there are {', '.join(self.metrics)}")
        offered = self.dimensions_of(metrics)
        for d in [*group_by, *(f.dimension for f in filters)]:
            if d not in offered:
                raise RequestError(f"{d!r} is no dimension of {', '.join(metrics)}; they share {', '.join(offered)}")
        for f in filters:
            if f.op not in OPERATORS and not (f.op == "in" and isinstance(f.value, tuple)):
                raise RequestError(f"no operator {f.op!r}; there are {', '.join(OPERATORS)}")
        for o in order_by:
            if o.lstrip("-") not in [*metrics, *group_by]:
                raise RequestError(f"ordered by {o!r}, which is not asked for")
        if limit is not None and not 1 <= limit <= MOST_ROWS:
            raise RequestError(f"the limit is from 1 to {MOST_ROWS}")

    # Plans

    def _source(self, model: Model, dimensions: Sequence[str]) -> DataFrame:
        """A fact with the dimensions asked for: every entity on their paths is joined once, left outer, with no more
        columns than needed."""
        reach = self._reach(model)
        fact = self.tables(model.table)
        paths = sorted({path[:i] for d in dimensions for path in [reach[d][0]] for i in range(1, len(path) + 1)}, key=len)
        at: dict[tuple[str, ...], Model] = {(): model}
        for path in paths:
            entity, target = path[-1], self.by_entity[path[-1]]
            left = "__".join([*path[:-1], at[path[:-1]].joins[entity]]) if path[:-1] else model.joins[entity]
            own = self.tables(target.table)
            wanted = {"__".join([*path, column]): F.col(column) for column in {target.key, *target.joins.values()}}
            wanted |= {d: F.expr(reach[d][1]) for d in dimensions if reach[d][0] == path}
            side = own.select(*[c.alias(f"__key_{n}" if n == "__".join([*path, target.key]) else n) for n, c in wanted.items()])
            fact = fact.join(side, F.col(left) == F.col("__key_" + "__".join([*path, target.key])), "left")
            at[path] = target
        own = {d: F.expr(reach[d][1]) for d in dimensions if not reach[d][0] and d not in fact.columns}
        return fact.withColumns(own) if own else fact

    def query(self, metrics: Sequence[str], group_by: Sequence[str] = (), filters: Sequence[Filter] = (), order_by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
        """The metrics by the dimensions, filtered first. Each fact is aggregated by itself and the results are joined in full
        on the dimensions, nulls meeting nulls. Sorted by ``order_by`` (``-name`` descending), else by the dimensions."""
        self.validate(metrics, group_by, filters, order_by, limit)
        leaves = list(dict.fromkeys(leaf for m in metrics for leaf in self._leaves(m)))
        by_fact: dict[str, list[str]] = {}
        for leaf in leaves:
            by_fact.setdefault(self.all_metrics[leaf].measure.model, []).append(leaf)
        parts = []
        for name, own in by_fact.items():
            rows = self._source(self.models[name], list(dict.fromkeys([*group_by, *(f.dimension for f in filters)])))
            for f in filters:
                rows = rows.where(f.holds())
            made = [self.all_metrics[leaf].measure.column().alias(leaf) for leaf in own]
            parts.append(rows.groupBy(*group_by).agg(*made))
        whole = reduce(lambda a, b: self._combine(a, b, group_by), parts)
        values = {m: self._value(m) for m in metrics}
        out = whole.select(*group_by, *[v.alias(m) for m, v in values.items()])
        return ordered(out, order_by or list(group_by), limit)

    @staticmethod
    def _combine(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
        if not keys:
            return a.crossJoin(b)
        other = b.withColumnsRenamed({k: f"__other_{k}" for k in keys})
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__other_{k}")) for k in keys])
        rest = [c for c in [*a.columns, *b.columns] if c not in keys]
        # A row of either side may be without partner; its keys then are the other's.
        return a.withColumn("__here", F.lit(True)).join(other, on, "full_outer").select(
            *[F.when(F.col("__here").isNotNull(), F.col(k)).otherwise(F.col(f"__other_{k}")).alias(k) for k in keys], *rest
        )

    def _value(self, name: str) -> Column:
        metric = self.all_metrics[name]
        return F.col(name) if metric.measure else F.try_divide(self._value(metric.ratio[0]).cast("double"), self._value(metric.ratio[1]))

    def dimension_values(self, dimensions: Sequence[str]) -> DataFrame:
        """All combinations of non-null values, from the first metric that offers the dimensions."""
        for name in self.metrics:
            if set(dimensions) <= set(self.dimensions_of([name])):
                model = self.models[self.all_metrics[self._leaves(name)[0]].measure.model]
                return self._source(model, dimensions).select(*dimensions).dropna().distinct()
        raise RequestError(f"no metric offers {', '.join(dimensions)} together")

    def metric_checks(self, by: str) -> DataFrame:
        """(``metric``, ``by``, ``expected_value``) of every offered metric, long, for reconciliation elsewhere."""
        by_fact: dict[str, list[str]] = {}
        for m in self.metrics:
            if by in self.dimensions_of([m]):
                by_fact.setdefault(self.all_metrics[self._leaves(m)[0]].measure.model, []).append(m)
        parts = []
        for own in by_fact.values():
            cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("expected_value")) for m in own])
            parts.append(self.query(own, [by]).select(by, F.explode(cells).alias("__c")).select("__c.metric", by, "__c.expected_value"))
        return reduce(DataFrame.unionByName, parts)


def parse_filter(text: str) -> Filter:
    """``dimension op value`` as typed in a shell; the value becomes a boolean, an integer, a number or a text."""
    for op in sorted(OPERATORS, key=len, reverse=True):
        name, found, value = text.partition(op)
        if found and name.strip() and not any(o in name for o in OPERATORS):
            return Filter(name.strip(), op, _typed(value.strip().strip("'\"")))
    raise RequestError(f"no filter: {text!r}; write dimension, operator and value")


def _typed(text: str) -> object:
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text
