"""Shell: ingestion and status of the raw layer, the model build, metric queries, questions and their evaluation, training and exports."""

from __future__ import annotations

import argparse
import io
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict
from pathlib import Path
from typing import Any, BinaryIO
from urllib.parse import quote
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession

from lodestack.export import export_all
from lodestack.plans.evaluation import VARIANTS, Tape, evaluate, gold, load_cases, summary, summary_text
from lodestack.plans.hospital_metrics import hospital_layer
from lodestack.plans.hospital_models import HOSPITAL
from lodestack.plans.questions import Agent, Model, Scripted
from lodestack.plans.semantic import MetricLayer, RequestError, parse_filter
from lodestack.session import local_session
from lodestack.sources.ingest import Web, ingest, ingest_summary
from lodestack.sources.registry import load_sources
from lodestack.sources.store import RawStore

MARTS = ("dim_county", "dim_fiscal_year", "dim_hospital", "fct_hospital_year", "fct_readmissions")

#: Columns of the modelling table that no model may learn from.
NO_FEATURES = ("facility_id", "fiscal_year", "split", "payment_reduction_pct", "is_penalized", "is_top_quarter_penalty")


class Mirror:
    """Files and metadata that were downloaded before: a folder with a file per address, its name quoted."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)

    def _read(self, url: str) -> bytes:
        return (self.folder / quote(url, safe="")).read_bytes()

    def __call__(self, url: str) -> BinaryIO:
        return io.BytesIO(self._read(url))

    def json(self, url: str) -> Any:
        return json.loads(self._read(url))


class Endpoint:
    """A chat model behind an address that takes messages and a JSON schema."""

    def __init__(self, url: str, name: str, timeout: float = 600.0) -> None:
        self.url, self.name, self.timeout = url, name, timeout

    def chat(self, messages: list[dict], schema: dict) -> str:
        body = json.dumps({"model": self.name, "messages": messages, "format": schema, "stream": False}).encode()
        with urlopen(Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as answer:  # noqa: S310
            return json.load(answer)["message"]["content"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestack")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *required: str, **optional: Any) -> argparse.ArgumentParser:
        one = verbs.add_parser(name)
        for r in required:
            one.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            one.add_argument(f"--{o}", default=default, type=type(default) if default is not None else str)
        return one

    one = verb("ingest", "raw", "sources", mirror=None, shared=None)
    one.add_argument("--force", action="store_true")
    one.add_argument("names", nargs="*")
    verb("status", "raw")
    verb("build", "raw", "out").add_argument("tables", nargs="*")
    verb("list", "marts")
    one = verb("query", "marts", limit=0)
    one.add_argument("metrics", nargs="+")
    for repeated in ("by", "where", "order"):
        one.add_argument(f"--{repeated}", action="append", default=[])
    verb("ask", "marts", endpoint=None, model="", replies=None).add_argument("question")
    one = verb("eval", "marts", "cases", endpoint=None, model="", tape=None, out=None)
    one.add_argument("--variant", action="append", choices=[v.name for v in VARIANTS])
    one = verb("train", "features", "out", draws=1000)
    one.add_argument("--family", action="append")
    verb("export", "marts", "out")
    return top


def _layer(spark: SparkSession, marts: str) -> MetricLayer:
    return hospital_layer(lambda name: spark.read.parquet(f"{marts}/{name}"))


def _agent(layer: MetricLayer, model: Model, rules: bool = True, examples: Sequence[tuple[str, str]] = ()) -> Agent:
    return Agent(layer, model, rules=rules, examples=examples, namesakes=("hospital__facility_name", "hospital__state"))


def _ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    sources = load_sources(args.sources)
    wanted = {n: s for n, s in sources.items() if not args.names or n in args.names}
    client = Mirror(args.mirror) if args.mirror else Web()
    results = ingest(spark, wanted, RawStore(args.raw), client, client, args.force, args.shared)
    print(ingest_summary(results))
    return int(any(r.error for r in results))


def _build(spark: SparkSession, args: argparse.Namespace) -> int:
    store = RawStore(args.raw)
    sources = {name: store.read(spark, name) for name in store.manifest()}
    _, outcomes, skipped = HOSPITAL.run(spark, sources, args.out, args.tables or None)
    for o in outcomes:
        if not o.passed:
            print(f"{o.severity}: {o.name} ({o.failures})")
    print(f"{sum(o.passed for o in outcomes)} of {len(outcomes)} checks passed; skipped: {', '.join(skipped) or 'none'}")
    return int(any(not o.passed and o.severity == "error" for o in outcomes))


def _list(spark: SparkSession, args: argparse.Namespace) -> int:
    print(json.dumps(_layer(spark, args.marts).describe(), indent=1))
    return 0


def _query(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        _layer(spark, args.marts).query(args.metrics, args.by, [parse_filter(w) for w in args.where], args.order, args.limit or None).show(500, truncate=False)
    except RequestError as wrong:
        print(wrong)
        return 2
    return 0


def _ask(spark: SparkSession, args: argparse.Namespace) -> int:
    model: Model = Scripted(json.loads(Path(args.replies).read_text())) if args.replies else Endpoint(args.endpoint, args.model)
    answer = _agent(_layer(spark, args.marts), model).ask(args.question)
    print("\n".join([answer.text, *(f"  {n}" for n in answer.notes)]))
    return int(answer.status == "failed")


def _eval(spark: SparkSession, args: argparse.Namespace) -> int:
    layer, cases = _layer(spark, args.marts), load_cases(args.cases)
    truth = gold(spark, {n: layer.tables(n) for n in MARTS}, cases)
    model = Endpoint(args.endpoint, args.model) if args.endpoint else None
    tape = Tape.load(args.tape) if args.tape and model is None else Tape() if args.tape else None
    examples = [(c.question, c.reference_reply()) for c in cases[:3]]
    variants = [v for v in VARIANTS if not args.variant or v.name in args.variant]
    found = evaluate(cases, lambda v, m: _agent(layer, m, v.rules, examples if v.examples else ()), truth, model, variants, tape)
    if model is not None and tape is not None:
        tape.save(args.tape)
    if args.out:
        rows = [{"variant": o.variant, "id": o.case.id, "status": o.answer.status, "seconds": o.seconds, **asdict(o.marks)} for o in found]
        Path(args.out).write_text(json.dumps({"summary": summary(found), "cases": rows}, indent=1))
    print(summary_text(summary(found)))
    return 0


def _train(spark: SparkSession, args: argparse.Namespace) -> int:
    from lodestack.ml.train import FAMILIES, run, write_report

    df = spark.read.parquet(args.features)
    features = [c for c in df.columns if c not in NO_FEATURES and not c.startswith("prior_")]
    report = run(df, features, "payment_reduction_pct", args.family or tuple(FAMILIES), draws=args.draws)
    write_report(report, args.out)
    print(f"{report['chosen']}: {json.dumps({n: m['test'] for n, m in report['models'].items()})}")
    return 0


def _export(spark: SparkSession, args: argparse.Namespace) -> int:
    layer = _layer(spark, args.marts)
    for name, rows in export_all(layer, {n: layer.tables(n) for n in MARTS}, args.out).items():
        print(f"{name}: {rows} rows")
    return 0


VERBS: dict[str, Callable[[SparkSession, argparse.Namespace], int]] = {"ingest": _ingest, "build": _build, "list": _list, "query": _query, "ask": _ask, "eval": _eval, "train": _train, "export": _export}


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "status":
        print(json.dumps(RawStore(args.raw).status(), indent=1))
        return 0
    return VERBS[args.verb](local_session(), args)


if __name__ == "__main__":
    raise SystemExit(main())
