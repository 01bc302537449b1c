"""Command line: generate, normalize, encode, inspect, query, events, verify, bench."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from . import archive, query, report, verify, workload
from .errors import ContractError, TierviewError
from .files import Store
from .functions.values import parse_filters, time_ns
from .operators.tiers import CLASSES
from .plans import contract as contracts
from .plans.admission import QuerySpec, read_workload
from .sources import adapters, canonical, generator


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tierview")
    p.add_argument("--json", action="store_true", help="errors as JSON")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate")
    g.add_argument("--scenario", required=True, choices=sorted(generator.SCENARIOS))
    size = g.add_mutually_exclusive_group(required=True)
    size.add_argument("--events", type=int)
    size.add_argument("--max-output-bytes", type=int)
    g.add_argument("--seed", type=int, required=True)
    g.add_argument("--output", required=True)
    n = sub.add_parser("normalize")
    n.add_argument("--adapter", required=True, choices=sorted(adapters.ADAPTERS))
    n.add_argument("--input", required=True)
    n.add_argument("--output", required=True)
    e = sub.add_parser("encode")
    e.add_argument("--input", required=True)
    e.add_argument("--contract", required=True)
    e.add_argument("--output", required=True)
    e.add_argument("--layout", default="auto", choices=("auto", "separate", "unified"))
    e.add_argument("--cardinality-limit", type=int, default=10_000_000)
    e.add_argument("--zstd-level", type=int, default=9)
    e.add_argument("--force", action="store_true")
    i = sub.add_parser("inspect")
    i.add_argument("archive")
    q = sub.add_parser("query")
    q.add_argument("archive")
    q.add_argument("--family", required=True)
    q.add_argument("--start", required=True)
    q.add_argument("--end", required=True)
    q.add_argument("--where", action="append", default=[])
    q.add_argument("--group-by", default="")
    q.add_argument("--measure", action="append", default=[])
    v = sub.add_parser("events")
    v.add_argument("archive")
    v.add_argument("--retained", default="all", choices=CLASSES)
    v.add_argument("--where", action="append", default=[])
    v.add_argument("--jsonl", action="store_true")
    c = sub.add_parser("verify")
    c.add_argument("archive")
    c.add_argument("--source")
    c.add_argument("--queries")
    b = sub.add_parser("bench")
    b.add_argument("--input", required=True)
    b.add_argument("--dataset", required=True)
    b.add_argument("--contract", required=True)
    b.add_argument("--output", required=True)
    return p


def _with_sidecar(spark: SparkSession, events: DataFrame, output: str, made_by: dict) -> dict:
    """Writes canonical lines, and beside them ``<output>.metadata.json``."""
    canonical.write_jsonl(events, output)
    found = made_by | generator.metadata(events) | {"content_hash": canonical.content_hash(events)}
    folder, _, name = output.rstrip("/").rpartition("/")
    Store(spark, folder or ".").write_text(f"{name}.metadata.json", json.dumps(found, indent=1, sort_keys=True))
    return found


def run(args: argparse.Namespace, spark: SparkSession) -> dict | None:
    if args.command == "generate":
        count = args.events if args.events is not None else args.max_output_bytes // 300 + 1
        events = generator.generate(spark, args.scenario, count, args.seed)
        if args.max_output_bytes is not None:
            events = generator.capped(events, args.max_output_bytes)
        return _with_sidecar(spark, events, args.output, {"scenario": args.scenario, "seed": args.seed})
    if args.command == "normalize":
        events = adapters.normalize(canonical.read_lines(spark, args.input), args.adapter)
        return _with_sidecar(spark, events, args.output, {"adapter": args.adapter})
    if args.command == "encode":
        options = archive.EncodeOptions(args.layout, args.cardinality_limit, args.zstd_level, force=args.force)
        return archive.encode(canonical.read_canonical(spark, args.input), contracts.load(args.contract), args.output, options).inspect()
    if args.command == "bench":
        return report.bench_canonical(spark, args.input, args.dataset, contracts.load(args.contract), args.output)
    found = archive.Archive.open(spark, args.archive)
    if args.command == "inspect":
        return found.inspect()
    if args.command == "query":
        split = lambda items: tuple(x for item in items for x in item.split(",") if x)
        return query.envelope(found, QuerySpec(args.family, time_ns(args.start), time_ns(args.end), parse_filters(args.where), split([args.group_by]), split(args.measure)))
    if args.command == "events":
        lines = (r[0] for r in found.events(args.retained, parse_filters(args.where)).select(canonical.canonical_json()).toLocalIterator())
        if args.jsonl:
            for line in lines:
                print(line)
            return None
        return {"schema_version": 1, "retained": args.retained, "cutoff_ns": found.manifest["cutoff_ns"], "events": [json.loads(x) for x in lines]}
    if bool(args.source) != bool(args.queries):
        raise ContractError("--source and --queries go together")
    if args.source:
        n = verify.verify_queries(found, canonical.read_canonical(spark, args.source), read_workload(args.queries))
        return {"verified": True, "queries": n}
    verify.verify(found)
    return {"verified": True}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        out = run(args, spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    except TierviewError as e:
        print(json.dumps({"error": str(e), "kind": type(e).__name__}) if args.json else f"{type(e).__name__}: {e}", file=sys.stderr)
        return e.exit_code
    if out is not None:
        print(json.dumps(out, indent=1, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
