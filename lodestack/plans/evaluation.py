"""How well questions are answered: answers beside those of hand-written SQL, by variant of the agent."""

from __future__ import annotations

import json
import math
import statistics
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from lodestack.plans.questions import Agent, Answer, Model, Scripted

TOLERANCE = 1e-9


@dataclass(frozen=True)
class Case:
    """A question with what a right answer shows: ``metric`` (any of them will do), ``keys`` (columns of the breakdown) and the rows of
    ``sql``; or, where it should be declined, ``reason``."""

    id: str
    question: str
    category: str = ""
    metric: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    sql: str | None = None
    plan: Mapping | None = None
    reason: str | None = None

    @classmethod
    def read(cls, raw: Mapping) -> Case:
        metric = raw.get("metric") or ()
        metric = (metric,) if isinstance(metric, str) else tuple(metric)
        reason = raw.get("reason") if raw.get("expect") == "decline" else None
        return cls(str(raw["id"]), raw["question"], raw.get("category", ""), metric, tuple(raw.get("keys") or ()), raw.get("sql"), raw.get("plan"), reason)

    def reference_reply(self) -> str:
        """What a model would say that makes no mistake."""
        if self.reason is not None:
            return json.dumps({"action": "decline", "decline_reason": self.reason})
        own = dict(self.plan or {})
        filters = [dict(zip(("dimension", "op", "value"), f)) if not isinstance(f, Mapping) else dict(f) for f in own.pop("filters", ())]
        return json.dumps({"action": "query", "filters": [f | {"value": str(f["value"])} for f in filters], **own})


def load_cases(path: str | Path) -> list[Case]:
    return [Case.read(raw) for raw in yaml.safe_load(Path(path).read_text())]


def gold(spark: SparkSession, tables: Mapping[str, DataFrame], cases: Iterable[Case]) -> dict[str, list[dict]]:
    """The rows of each case's SQL over the tables as temporary views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return {c.id: [r.asDict() for r in spark.sql(c.sql).collect()] for c in cases if c.sql}


@dataclass(frozen=True)
class Marks:
    """What is right in an answer; None where nothing could be judged."""

    action: bool
    metric: bool | None = None
    breakdown: bool | None = None
    rows: bool | None = None
    values: bool | None = None

    @property
    def right(self) -> bool:
        return all(x is not False for x in asdict(self).values())


def close(a: object, b: object) -> bool:
    """Equal figures: both missing, or within a relative tolerance."""
    gone = [x is None or x != x for x in (a, b)]
    return all(gone) if any(gone) else math.isclose(float(a), float(b), rel_tol=TOLERANCE, abs_tol=TOLERANCE)


def mark(case: Case, answer: Answer, truth: Sequence[Mapping] | None) -> Marks:
    """Rows are told apart by the case's keys, whatever the answer calls its columns: keys are taken in order of the breakdown."""
    if case.reason is not None:
        return Marks(answer.status == "declined", None, None, None, None)
    if answer.status != "answered" or answer.plan is None:
        return Marks(False, False, False, False, False)
    shown, plan = [m for m in answer.plan.metrics if m in case.metric], answer.plan
    breakdown = len(plan.group_by) == len(case.keys)
    if not shown or not breakdown or truth is None:
        return Marks(True, bool(shown), breakdown, False, False)
    value = next((c for c in (truth[0] if truth else {}) if c not in case.keys), None)
    orders = [plan.group_by] if set(case.keys) - set(plan.group_by) else [case.keys]
    want = {tuple(str(r[k]) for k in case.keys): r[value] for r in truth}
    have = {tuple(str(r[k]) for k in orders[0]): r[shown[0]] for r in answer.rows}
    rows = set(want) == set(have)
    return Marks(True, True, True, rows, rows and all(close(have[k], want[k]) for k in want))


@dataclass(frozen=True)
class Variant:
    """An agent with or without something, to see what it is worth."""

    name: str
    examples: bool = True
    rules: bool = True


VARIANTS = (Variant("full"), Variant("no_examples", examples=False), Variant("no_rules", rules=False))


class Tape:
    """Keeps what a model replies to each case of each variant, and plays it again without the model."""

    def __init__(self, replies: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> None:
        self.replies: dict[str, dict[str, list[str]]] = {v: {c: list(r) for c, r in cases.items()} for v, cases in (replies or {}).items()}

    def recording(self, model: Model, variant: str, case: str) -> Model:
        kept = self.replies.setdefault(variant, {}).setdefault(case, [])

        class Kept:
            def chat(self, messages: list[dict], schema: dict) -> str:
                kept.append(model.chat(messages, schema))
                return kept[-1]

        return Kept()

    def playing(self, variant: str, case: str) -> Model:
        return Scripted(self.replies[variant][case])

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.replies, indent=1))

    @classmethod
    def load(cls, path: str | Path) -> Tape:
        return cls(json.loads(Path(path).read_text()))


@dataclass(frozen=True)
class Outcome:
    variant: str
    case: Case
    marks: Marks
    seconds: float
    answer: Answer


def evaluate(cases: Sequence[Case], agent: Callable[[Variant, Model], Agent], truth: Mapping[str, Sequence[Mapping]], model: Model | None = None, variants: Sequence[Variant] = VARIANTS, tape: Tape | None = None) -> list[Outcome]:
    """Every case by every variant. With a ``model`` its replies are kept on the ``tape``; without one the tape is played;
    without either each case's own plan is."""
    out = []
    for variant in variants:
        for case in cases:
            if model is not None:
                speaker = tape.recording(model, variant.name, case.id) if tape is not None else model
            else:
                speaker = tape.playing(variant.name, case.id) if tape is not None else Scripted([case.reference_reply()] * 2)
            answer = agent(variant, speaker).ask(case.question)
            out.append(Outcome(variant.name, case, mark(case, answer, truth.get(case.id)), answer.seconds, answer))
    return out


def _share(of: Iterable[bool | None]) -> float | None:
    known = [x for x in of if x is not None]
    return sum(known) / len(known) if known else None


def summary(outcomes: Sequence[Outcome]) -> dict[str, dict]:
    """Of each variant: the share right, by aspect and by category, and the median and 90th percentile of seconds."""
    out = {}
    for variant in dict.fromkeys(o.variant for o in outcomes):
        own = [o for o in outcomes if o.variant == variant]
        seconds = sorted(o.seconds for o in own)
        out[variant] = {
            "cases": len(own),
            "accuracy": _share(o.marks.right for o in own),
            **{a: _share(getattr(o.marks, a) for o in own) for a in ("action", "metric", "breakdown", "rows", "values")},
            "by_category": {c: _share(o.marks.right for o in own if o.case.category == c) for c in dict.fromkeys(o.case.category for o in own)},
            "p50": statistics.median(seconds),
            "p90": seconds[math.ceil(0.9 * len(seconds)) - 1],
        }
    return out


def summary_text(found: Mapping[str, Mapping]) -> str:
    return "\n".join(f"{v}: {s['accuracy']:.0%} of {s['cases']} right, {s['p50']:.1f} s (9 of 10 within {s['p90']:.1f} s)" for v, s in found.items())
