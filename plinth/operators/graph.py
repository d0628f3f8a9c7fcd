"""Property-graph operators on nodes and edges tables.

nodes: doc_id, id, node_type, ord and anything else.  edges: doc_id, source_id,
target_id, relation, ord and anything else.  ``ord`` is the order of insertion.
Keys are given as lists, so that tables of other shapes work too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import schema


def numbered(rows: DataFrame, by: list[str], order: list[str], out: str, ranges: int | None = None) -> DataFrame:
    """rows with ``out``, the place from 0 among those equal in ``by``, in order.

    The rows are dealt by ranges of (by, order) and counted, and a row's place is its
    place in its range after the rows of its kind in the ranges before: a kind with most
    of the rows is spread over many tasks.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # checkpointed, so that the boundaries that were sampled hold for both uses
    dealt = cut(rows.repartitionByRange(ranges, *by, *order).withColumn("range_", F.spark_partition_id()))
    sizes = dealt.groupBy(*by, "range_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(c).alias(f"{c}_key_") for c in by], F.col("range_").alias("range_key_"), F.coalesce(before, F.lit(0)).alias("before_"))
    keyed = dealt.join(starts, [F.col(c).eqNullSafe(F.col(f"{c}_key_")) for c in by] + [F.col("range_") == F.col("range_key_")])
    place = F.row_number().over(Window.partitionBy(*by, "range_").orderBy(*order)) - 1 + F.col("before_")
    return keyed.select(*rows.columns, place.alias(out))


def fallback_ids(rows: DataFrame, kind: str, order: list[str], given: str, scope: list[str], out: str = "id") -> DataFrame:
    """The given id, or kind_N, N counting the rows of a kind without one, in order.

    Within a scope (a document) a window counts; without one there are as few groups as kinds, which are spread.
    """
    missing = F.col(given).isNull() | (F.trim(F.col(given)) == "")
    if scope:
        n = F.row_number().over(Window.partitionBy(*scope, kind, missing.cast("int")).orderBy(*order))
        return rows.withColumn(out, F.when(missing, F.concat(F.lower(kind), F.lit("_"), n)).otherwise(F.col(given)))
    counted = numbered(rows.withColumn("missing_", missing.cast("int")), [kind, "missing_"], order, "place_")
    made = F.concat(F.lower(kind), F.lit("_"), F.col("place_") + 1)
    return counted.select(*rows.columns, F.when(F.col("missing_") == 1, made).otherwise(F.col(given)).alias(out))


def last_wins(nodes: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key, the last in order; ``first_ord`` is the place of the first."""
    by = Window.partitionBy(*key)
    ranked = nodes.withColumn("last_", F.row_number().over(by.orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])))
    return ranked.withColumn("first_ord", F.min(order[0]).over(by)).where("last_ = 1").drop("last_")


def first_wins(edges: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key, the first in order."""
    ranked = edges.withColumn("first_", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("first_ = 1").drop("first_")


def typed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the types of their ends, null where an end does not exist."""
    ends = lambda side: nodes.select(F.col("doc_id"), F.col("id").alias(f"{side}_id"), F.col("node_type").alias(f"{side}_type"))
    return edges.join(ends("source"), ["doc_id", "source_id"], "left").join(ends("target"), ["doc_id", "target_id"], "left")


def judge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their ends' types and ``reason``: null for legal ones."""
    triples = F.broadcast(schema.allowed_triples(edges.sparkSession).withColumn("legal", F.lit(True)))
    typed = typed_edges(edges, nodes).join(triples, ["source_type", "relation", "target_type"], "left")
    reason = (
        F.when(F.col("source_type").isNull(), F.lit("missing source"))
        .when(F.col("target_type").isNull(), F.lit("missing target"))
        .when(F.col("legal").isNull(), F.lit("illegal triple"))
    )
    return typed.withColumn("reason", reason).drop("legal")


def add_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legal edges, the first of each (source, relation, target); and the rejected ones with a reason."""
    judged = judge_edges(edges, nodes)
    legal = judged.where("reason is null").drop("reason", "source_type", "target_type")
    return first_wins(legal, ["doc_id", "source_id", "relation", "target_id"], ["ord"]), judged.where("reason is not null")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem, source_id, relation, target_id: missing ends and repeated edges."""
    ids = lambda side: nodes.select("doc_id", F.col("id").alias(f"{side}_id"))
    columns = ["doc_id", "source_id", "relation", "target_id"]
    problem = lambda name, rows: rows.select(F.lit(name).alias("problem"), *columns)
    repeated = edges.groupBy(*columns).count().where("count > 1")
    return (
        problem("missing source", edges.join(ids("source"), ["doc_id", "source_id"], "left_anti"))
        .unionByName(problem("missing target", edges.join(ids("target"), ["doc_id", "target_id"], "left_anti")))
        .unionByName(problem("repeated edge", repeated))
    )


def edge_index(edges: DataFrame, relation: str) -> DataFrame:
    """source_id and its sorted targets over one relation."""
    return edges.where(F.col("relation") == relation).groupBy("doc_id", "source_id").agg(F.sort_array(F.collect_set("target_id")).alias("targets"))


def id_index(nodes: DataFrame) -> DataFrame:
    """doc_id, gml_id and the sorted ids of the nodes that carry it; one element may give several."""
    given = nodes.withColumn("gml_id", F.trim("gml_id")).where("gml_id <> ''")
    return given.groupBy("doc_id", "gml_id").agg(F.sort_array(F.collect_set("id")).alias("node_ids"))


def closure(edges: DataFrame, starts: DataFrame, source: str = "source_id", target: str = "target_id", checkpoint_every: int = 4) -> DataFrame:
    """(start, node): all nodes that a start reaches by one edge or more; cycles are safe.

    Semi-naive: each round joins only the pairs found last, and drops known ones.
    """
    step = edges.select(F.col(source).alias("from_"), F.col(target).alias("to_")).distinct()
    found = starts.select(F.col("start")).distinct().join(step, F.col("start") == F.col("from_")).select("start", F.col("to_").alias("node")).distinct()
    found = frontier = cut(found)
    turn = 0
    while not frontier.isEmpty():
        turn += 1
        fresh = frontier.join(step, F.col("node") == F.col("from_")).select("start", F.col("to_").alias("node")).distinct()
        frontier = fresh.join(found, ["start", "node"], "left_anti")
        frontier = cut(frontier)
        found = found.unionByName(frontier)
        if turn % checkpoint_every == 0:
            found = cut(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the folder that spark.checkpoint.dir names.

    Where none is named, a local session gets one of its own; a cluster has to name one.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp(prefix="plinth-graph-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@dataclass
class SceneGraph:
    nodes: DataFrame
    edges: DataFrame

    def match(self, source_type: str | None, relation: str, target_type: str | None) -> DataFrame:
        """Edges of one pattern, with the types of their ends."""
        typed = typed_edges(self.edges.where(F.col("relation") == relation), self.nodes)
        for side, kind in (("source", source_type), ("target", target_type)):
            if kind is not None:
                typed = typed.where(F.col(f"{side}_type") == kind)
        return typed

    def replace_edges(self, edges: DataFrame) -> "SceneGraph":
        return SceneGraph(self.nodes, edges)


def connected(pairs: DataFrame, left: str = "source_id", right: str = "target_id") -> DataFrame:
    """Unordered room pairs joined by a door: distinct (a, b) with a < b."""
    return pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a < b").distinct()
