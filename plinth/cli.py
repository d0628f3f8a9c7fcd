"""Command line: import, benchmark, profile, relations, export, check."""

from __future__ import annotations

import argparse
import json
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plinth.operators import graph
from plinth.plans import importer
from plinth.sources.store import GraphStore, write_json


def _session() -> SparkSession:
    return SparkSession.builder.appName("plinth").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def stats(values: list[float]) -> dict[str, float]:
    """avg, min, max and population deviation, 6 places; zeros where there is nothing."""
    if not values:
        return {"avg": 0.0, "min": 0.0, "max": 0.0, "std": 0.0}
    std = statistics.pstdev(values) if len(values) > 1 else 0.0
    return {k: round(v, 6) for k, v in (("avg", statistics.fmean(values)), ("min", min(values)), ("max", max(values)), ("std", std))}


def cmd_import(a: argparse.Namespace) -> int:
    status, summary = importer.run_import(_session(), a.input, a.output, a.config, a.store)
    if summary:
        print(importer.report(summary))
    return status


def cmd_benchmark(a: argparse.Namespace) -> int:
    """The five pattern counts on a stored graph: warm-ups, then timed repeats; one failure does not stop the rest."""
    if a.warmup < 0 or a.repeat < 1:
        print("--warmup must not be negative, --repeat must be positive", file=sys.stderr)
        return importer.BAD_INPUT
    stored = GraphStore(_session(), a.store).load()
    if stored is None:
        print(f"no graph in {a.store}", file=sys.stderr)
        return importer.BAD_INPUT
    report: dict = {"node_count": stored.nodes.count(), "queries": {}}
    failed = False
    for name in [n for n, *_ in importer.SUITE] + ["q5_inside_room_touching_opening"]:
        try:
            took: list[float] = []
            for k in range(a.warmup + a.repeat):
                began = time.perf_counter()
                n = importer.count_one(stored, name)
                if k >= a.warmup:
                    took.append((time.perf_counter() - began) * 1000)
            report["queries"][name] = {"count": n} | {f"{k}_ms": v for k, v in stats(took).items()}
        except Exception as e:
            failed, report["queries"][name] = True, {"error": str(e)[:300]}
    text = json.dumps(report, indent=2)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    print(text)
    return importer.FAILED if failed else importer.OK


def cmd_profile(a: argparse.Namespace) -> int:
    """N import runs, and per stage the statistics of those that succeeded."""
    if a.runs < 1:
        return importer.BAD_INPUT
    spark, runs = _session(), []
    for k in range(a.runs):
        began = time.perf_counter()
        status, summary = importer.run_import(spark, a.input, f"{a.output}/run-{k + 1}", a.config, a.store)
        runs.append({"status": status, "wall": time.perf_counter() - began, "summary": summary})
    good = [r for r in runs if r["status"] == importer.OK]
    stages = sorted({s for r in good for s in r["summary"]["stage_durations"]})
    report = {"runs": len(runs), "successful_runs": len(good), "wall": stats([r["wall"] for r in good]), "stages": {s: stats([r["summary"]["stage_durations"].get(s, 0.0) for r in good]) for s in stages}}
    with open(a.report, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2)
    return importer.OK if len(good) == len(runs) else importer.FAILED


def cmd_relations(a: argparse.Namespace) -> int:
    """Relation counts of a stored graph, by relation and the types of its ends."""
    found = GraphStore(_session(), a.store).load()
    if found is None:
        print(f"no graph in {a.store}", file=sys.stderr)
        return importer.BAD_INPUT
    typed = graph.typed_edges(found.edges, found.nodes)
    if a.relation:
        typed = typed.where(F.col("relation") == a.relation)
    for r in typed.groupBy("relation", "source_type", "target_type").count().orderBy("relation", "source_type", "target_type").collect():
        print(f"{r.relation} {r.source_type} -> {r.target_type}: {r['count']}")
    return importer.OK


def cmd_export(a: argparse.Namespace) -> int:
    """A stored graph as JSON lines or Parquet."""
    found = GraphStore(_session(), a.store).load()
    if found is None:
        print(f"no graph in {a.store}", file=sys.stderr)
        return importer.BAD_INPUT
    if a.format == "json":
        write_json(found, a.output)
    else:
        found.nodes.write.mode("overwrite").parquet(f"{a.output}/nodes")
        found.edges.write.mode("overwrite").parquet(f"{a.output}/edges")
    return importer.OK


def check(baseline: dict, actual: dict) -> list[tuple[bool, str]]:
    """baseline: dotted path -> {min, max, equals}; a value that is missing counts as -1."""
    lines = []
    for path, limit in sorted(baseline.items()):
        value: object = actual
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        number = float(value) if isinstance(value, (int, float)) else -1.0
        ok = number >= limit.get("min", number) and number <= limit.get("max", number) and number == limit.get("equals", number)
        lines.append((ok, f"{'PASS' if ok else 'FAIL'} {path} = {number:g} {json.dumps(limit)}"))
    return lines


def cmd_check(a: argparse.Namespace) -> int:
    with open(a.baseline, encoding="utf-8") as f:
        baseline = json.load(f)
    with open(a.actual, encoding="utf-8") as f:
        actual = json.load(f)
    lines = check(baseline, actual)
    ok = all(x for x, _ in lines)
    print("\n".join([*(t for _, t in lines), "PASS" if ok else "FAIL"]))
    return importer.OK if ok else importer.FAILED


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plinth")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("import")
    p.add_argument("--input", required=True), p.add_argument("--output", required=True), p.add_argument("--store"), p.add_argument("--config")
    p.set_defaults(run=cmd_import)
    p = sub.add_parser("benchmark")
    p.add_argument("--store", required=True), p.add_argument("--output"), p.add_argument("--warmup", type=int, default=1), p.add_argument("--repeat", type=int, default=3)
    p.set_defaults(run=cmd_benchmark)
    p = sub.add_parser("profile")
    p.add_argument("--input", required=True), p.add_argument("--output", required=True), p.add_argument("--report", required=True), p.add_argument("--runs", type=int, default=3), p.add_argument("--store"), p.add_argument("--config")
    p.set_defaults(run=cmd_profile)
    p = sub.add_parser("relations")
    p.add_argument("--store", required=True), p.add_argument("--relation")
    p.set_defaults(run=cmd_relations)
    p = sub.add_parser("export")
    p.add_argument("--store", required=True), p.add_argument("--output", required=True), p.add_argument("--format", choices=["json", "parquet"], default="json")
    p.set_defaults(run=cmd_export)
    p = sub.add_parser("check")
    p.add_argument("--baseline", required=True), p.add_argument("--actual", required=True)
    p.set_defaults(run=cmd_check)
    a = parser.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
