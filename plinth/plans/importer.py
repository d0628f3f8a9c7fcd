"""Import runs: documents to a graph, its scorecard and its files."""

from __future__ import annotations

import json
import logging
import os
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import scalar
from plinth.operators import construct, graph, score, summary
from plinth.sources import config as configuration
from plinth.sources.citygml import read_elements
from plinth.sources.store import GraphStore, write_json

LOG = logging.getLogger(__name__)
OK, BAD_INPUT, FAILED = 0, 2, 3


@contextmanager
def timed(stage: str, durations: dict[str, float]):
    began = time.perf_counter()
    LOG.info("START %s", stage)
    yield
    durations[stage] = round(time.perf_counter() - began, 6)
    LOG.info("DONE %s in %.3f s", stage, durations[stage])


def run_import(spark: SparkSession, path: str, output: str, config_path: str | None = None, store: str | None = None) -> tuple[int, dict]:
    """Reads documents, builds the graph, writes nodes, edges and summary below ``output``; (exit code, summary)."""
    if "://" not in path and not any(c in path for c in "*?[") and not os.path.exists(path):
        LOG.error("no such input: %s", path)
        return BAD_INPUT, {}
    config = configuration.load(config_path)
    durations: dict[str, float] = {}
    with timed("parse_xml", durations):
        elements = graph.cut(read_elements(spark, path))
    with timed("build_graph", durations):
        built = construct.build(elements, config.thresholds, config.enable_relations)
    with timed("scorecard", durations):
        sections = summarise(built)
        sections["scorecard"].write.mode("overwrite").json(f"{output}/scorecard")
        sections["building_breakdown"].write.mode("overwrite").json(f"{output}/building_breakdown")
        # counts by type and totals: as many rows as there are types, whatever the documents
        nodes = {r.node_type: r.n for r in built.graph.nodes.groupBy("node_type").agg(F.count("*").alias("n")).collect()}
        edges = {r.relation: r.n for r in built.graph.edges.groupBy("relation").agg(F.count("*").alias("n")).collect()}
        totals = {k: [r.asDict() for r in df.collect()] for k, df in sections.items() if k not in ("scorecard", "building_breakdown")}
        cards = overall_of(sections["scorecard"])
    status, stored = OK, {"enabled": store is not None}
    if store is not None:
        with timed("export_store", durations):
            try:
                stored |= GraphStore(spark, store).save(built.graph)
            except Exception as e:  # the run goes on and says so in its exit code
                LOG.exception("the store could not be written")
                status, stored["error"] = FAILED, str(e)[:500]
    with timed("export_json", durations):
        write_json(built.graph, output)
    durations["total"] = round(sum(durations.values()), 6)
    summary = {
        "input_path": path, "node_count": sum(nodes.values()), "edge_count": sum(edges.values()), "node_type_counts": dict(sorted(nodes.items())), "relation_counts": dict(sorted(edges.items())),
        **totals, "scorecard": cards, "criteria": CRITERIA, "store_export": stored, "stage_durations": durations,
    }
    spark.createDataFrame([(json.dumps(summary, indent=2, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/summary")
    return status, summary


CRITERIA = "overall = 0.40 nodes + 0.30 relations + 0.30 properties, each the share of what the documents promise that the graph holds; spatial scores stand beside it"


def summarise(built: construct.Built) -> dict[str, DataFrame]:
    """The sections of a summary: a card a document and a row a building as tables, totals over all documents as few rows."""
    pairs = score.pair_stats(built)
    appearance = score.appearance_coverage(built).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "linked", "unresolved")])
    appearance = appearance.withColumn("coverage", scalar.safe_ratio(F.col("linked"), F.col("total")) * 100)
    rich = score.enrichment(built.graph.nodes).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("nodes", "named", "attributed", "attributes")])
    share = lambda c: scalar.safe_ratio(F.col(c), F.col("nodes")) * 100
    rich = rich.withColumn("named_percent", share("named")).withColumn("attributed_percent", share("attributed"))
    dense = [summary.density(built.graph.edges.where(F.col("relation") == r), ["doc_id", "source_id"], ["relation"]) for r in ("HAS_RING", "HAS_POS")]
    themes = score.theme_coverage(built.graph).agg(F.coalesce(F.min("present"), F.lit(0)).alias("least"), F.coalesce(F.avg("present"), F.lit(0.0)).alias("average"), F.lit(5).alias("families"))
    return {
        "scorecard": score.scorecard(built), "building_breakdown": score.building_breakdown(built), "spatial_pair_stats": pairs, "appearance_coverage": appearance,
        "property_enrichment": rich, "geometry_density": dense[0].unionByName(dense[1]), "theme_coverage": themes,
    }


def overall_of(cards: DataFrame) -> dict:
    """The mean scores of all documents, and how many there are."""
    names = ("overall", "node_score", "relation_score", "property_score", "spatial_coverage", "spatial_sanity")
    row = cards.agg(F.count("*").alias("documents"), *[F.round(F.avg(c), 2).alias(c) for c in names]).head()
    return row.asDict()


def report(summary: dict) -> str:
    """The conversion report as text."""
    line = lambda d: ", ".join(f"{k}={v:g}" if isinstance(v, float) else f"{k}={v}" for k, v in d.items())
    rows = lambda key: [f"  {line(r)}" for r in summary[key]] or ["  none"]
    counts = lambda key: f"  {line(dict(sorted(summary[key].items())))}"
    seconds = {k: v for k, v in summary["stage_durations"].items() if k != "total"}
    longest = max(seconds.values(), default=0.0)
    score_ = summary["scorecard"]
    lines = ["Summary", f"  input {summary['input_path']}: {summary['node_count']} nodes, {summary['edge_count']} edges", "Distribution", counts("node_type_counts"), counts("relation_counts")]
    for title, key in (("Property enrichment", "property_enrichment"), ("Appearance coverage", "appearance_coverage"), ("Geometry density", "geometry_density"), ("Spatial pairs", "spatial_pair_stats"), ("Themes", "theme_coverage")):
        lines += [title, *rows(key)]
    # the table of buildings has a row each, so it stays a table
    lines += ["Building breakdown", "  see building_breakdown beside this summary"]
    lines += ["Scores", f"  documents {score_['documents']}: overall {score_['overall'] or 0:.2f}, nodes {score_['node_score'] or 0:.2f}, relations {score_['relation_score'] or 0:.2f}, properties {score_['property_score'] or 0:.2f}, spatial {score_['spatial_coverage'] or 0:.2f}, sanity {score_['spatial_sanity'] or 0:.2f}", f"  {summary['criteria']}"]
    done = {"documents": bool(score_["documents"]), "nodes": bool(summary["node_count"]), "edges": bool(summary["edge_count"]), "store": "error" not in summary["store_export"]}
    lines += ["Checklist", *[f"  [{'x' if ok else ' '}] {k}" for k, ok in done.items()]]
    width = 26
    lines += ["Timeline", *[f"  {k:<14} {'#' * round(width * v / longest) if longest else '':-<{width}} {v:.3f} s" for k, v in seconds.items()]]
    return "\n".join(lines)


#: The pattern-count suite: name, source type, relation, target type.
SUITE = [
    ("q1_furniture_furniture_intersects", "BuildingFurniture", "INTERSECTS", "BuildingFurniture"),
    ("q2_furniture_opening_touches", "BuildingFurniture", "TOUCHES", "Opening"),
    ("q3_furniture_boundary_adjacent", "BuildingFurniture", "ADJACENT_TO", "BoundarySurface"),
    ("q4_opening_connects_room", "Opening", "CONNECTS", "Room"),
]


def count_one(g, name: str) -> int:
    """One count of the suite."""
    for known, a, relation, b in SUITE:
        if name == known:
            rows = g.match(a, relation, b)
            return (rows.where("source_id < target_id") if name.startswith("q1") else rows).count()
    inside = g.match("BuildingFurniture", "INSIDE", "Room").select("doc_id", F.col("source_id").alias("f"), F.col("target_id").alias("room"))
    connects = g.match("Opening", "CONNECTS", "Room").select("doc_id", F.col("source_id").alias("o"), F.col("target_id").alias("room"))
    touches = g.match("BuildingFurniture", "TOUCHES", "Opening").select("doc_id", F.col("source_id").alias("f"), F.col("target_id").alias("o"))
    return touches.join(inside, ["doc_id", "f"]).join(connects, ["doc_id", "o", "room"]).select("doc_id", "f").distinct().count()


def count_suite(g) -> dict[str, int]:
    """The five counts on a graph."""
    return {name: count_one(g, name) for name in [n for n, *_ in SUITE] + ["q5_inside_room_touching_opening"]}
