"""Queries over the star-schema tables, each with its SQL.

The projection: regions, nations and orders stand for buildings, parts and rooms;
lineitems flagged A, R and N for furniture, openings and boundary surfaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import boxes, scalar
from plinth.functions.boxes import Thresholds
from plinth.operators import graph, schema, spatial, summary, tree

T = Thresholds(touch=0.05, adjacent=2.5, intersection=1e-6)
FLAGS = {"A": "BuildingFurniture", "R": "Opening", "N": "BoundarySurface"}

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None):
    def keep(fn):
        _QUERIES[name] = (fn, sql)
        return fn

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- projection

def _id(prefix: str = "l_") -> str:
    return f"concat({prefix}returnflag, '_', {prefix}orderkey, '_', {prefix}linenumber)"


_KIND_SQL = "CASE l_returnflag WHEN 'A' THEN 'BuildingFurniture' WHEN 'R' THEN 'Opening' ELSE 'BoundarySurface' END"


def points(spark: SparkSession, folder: str) -> DataFrame:
    li = read(spark, folder, "lineitem")
    return li.select(
        F.expr(_id()).alias("id"), F.col("l_orderkey").alias("room"), F.col("l_returnflag").alias("flag"), F.expr(_KIND_SQL).alias("node_type"),
        F.when(F.col("l_linestatus") == "F", "Door").otherwise("Window").alias("opening_type"),
        F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z"),
    )


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """id, room, flag and the box of every object, dealt by room: the boxes and the pairs need no other exchange."""
    low = [F.col(a) for a in boxes.AXES]
    return spatial.extract_bbox(points(spark, folder).repartition("room"), ["id", "room", "flag"], low, [c + 1 for c in low])


_P = f"""p AS (
  SELECT {_id()} AS id, l_orderkey AS room, l_returnflag AS flag, {_KIND_SQL} AS node_type,
         CASE WHEN l_linestatus = 'F' THEN 'Door' ELSE 'Window' END AS opening_type,
         l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z
  FROM lineitem
)"""
_B = f"""{_P}, b AS (
  SELECT id, room, flag, min(x) AS min_x, max(x + 1) AS max_x, min(y) AS min_y, max(y + 1) AS max_y, min(z) AS min_z, max(z + 1) AS max_z
  FROM p GROUP BY id, room, flag
)"""
_GAP = "greatest(b.min_{k} - a.max_{k}, a.min_{k} - b.max_{k}, 0.0)"
_OVER = "least(a.max_{k}, b.max_{k}) - greatest(a.min_{k}, b.min_{k})"
_each = lambda part, sep: sep.join(part.format(k=k) for k in boxes.AXES)
_DIST = f"sqrt({_each(f'{_GAP} * {_GAP}', ' + ')})"
_PAIR = "FROM b AS a JOIN b AS b ON a.room = b.room AND a.id <> b.id AND (a.flag = 'A' OR b.flag = 'A')"
_REL = f"CASE WHEN {_each(f'{_OVER} > 1e-6', ' AND ')} THEN 'INTERSECTS' WHEN {_DIST} <= 0.05 THEN 'TOUCHES' WHEN {_DIST} <= 2.5 THEN 'ADJACENT_TO' END"
_R = f"""{_B}, r AS (
  SELECT a.room, a.id AS source_id, b.id AS target_id, a.flag AS source_flag, b.flag AS target_flag, {_REL} AS relation, {_DIST} AS distance {_PAIR}
)"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Directed pairs of a room with furniture on one side."""
    return spatial.seeded_pairs(objects(spark, folder), ["room"], F.col("flag") == "A")


def relations(spark: SparkSession, folder: str) -> DataFrame:
    found = spatial.infer(candidates(spark, folder), T)
    return found.select("room", F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), F.col("a_flag").alias("source_flag"), F.col("b_flag").alias("target_flag"), "relation", "distance", "confidence")


@query("spatial_relations", f"WITH {_R} SELECT room, source_id, target_id, relation, CASE relation WHEN 'INTERSECTS' THEN 0.95 WHEN 'TOUCHES' THEN 0.90 ELSE 0.80 END::DOUBLE AS confidence FROM r WHERE relation IS NOT NULL")
def spatial_relations(spark, folder):
    return relations(spark, folder).where("relation is not null").select("room", "source_id", "target_id", "relation", "confidence")


@query("spatial_relation_counts", f"WITH {_R} SELECT coalesce(relation, 'none') AS relation, count(*) AS n FROM r GROUP BY 1")
def spatial_relation_counts(spark, folder):
    return summary.count_by(relations(spark, folder).withColumn("relation", F.coalesce("relation", F.lit("none"))), "relation")


@query("spatial_near_pairs_grid", f"WITH {_R} SELECT relation, count(*) AS n FROM r WHERE relation IS NOT NULL GROUP BY 1")
def spatial_near_pairs_grid(spark, folder):
    near = spatial.near_pairs(objects(spark, folder), ["room"], T.adjacent, 8.0, F.col("flag") == "A")
    return summary.count_by(spatial.infer(near, T).where("relation is not null"), "relation")


@query("bbox_per_object", f"WITH {_B} SELECT * FROM b")
def bbox_per_object(spark, folder):
    return objects(spark, folder)


@query("axis_gap_overlap", f"WITH {_B} SELECT a.id AS source_id, b.id AS target_id, {_each(_GAP + ' AS gap_{k}, ' + _OVER + ' AS overlap_{k}', ', ')} {_PAIR}")
def axis_gap_overlap(spark, folder):
    columns = [c for k in boxes.AXES for c in (boxes.axis_gap("a_", "b_", k).alias(f"gap_{k}"), boxes.axis_overlap("a_", "b_", k).alias(f"overlap_{k}"))]
    return candidates(spark, folder).select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), *columns)


@query("bbox_distance_pairs", f"WITH {_B} SELECT a.id AS source_id, b.id AS target_id, {_DIST} AS distance {_PAIR}")
def bbox_distance_pairs(spark, folder):
    return candidates(spark, folder).select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), boxes.distance("a_", "b_").alias("distance"))


_CONTAINS = _each("a.min_{k} <= b.min_{k} AND b.max_{k} <= a.max_{k}", " AND ")
_CLOSED = _each("a.min_{k} <= b.max_{k} AND b.min_{k} <= a.max_{k}", " AND ")


@query("bbox_contains", f"WITH {_B} SELECT a.id AS source_id, b.id AS target_id {_PAIR} WHERE {_CONTAINS}")
def bbox_contains(spark, folder):
    return candidates(spark, folder).where(boxes.contains("a_", "b_")).select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"))


@query("bbox_touches_closed", f"WITH {_B} SELECT a.id AS source_id, b.id AS target_id {_PAIR} WHERE {_CLOSED}")
def bbox_touches_closed(spark, folder):
    return candidates(spark, folder).where(boxes.touches_closed("a_", "b_")).select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"))


@query("centroids", f"WITH {_B} SELECT id, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y, (min_z + max_z) / 2 AS z FROM b")
def centroids(spark, folder):
    return objects(spark, folder).select("id", boxes.centroid().alias("c")).select("id", "c.x", "c.y", "c.z")


_ROOMBOX = "room_box AS (SELECT room, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y, min(min_z) AS min_z, max(max_z) AS max_z FROM b WHERE flag = 'N' GROUP BY room)"


@query("room_furniture_rules", f"WITH {_B}, {_ROOMBOX} SELECT a.room, b.id, {_CONTAINS} AS inside, {_CLOSED} AS adjacent FROM room_box a JOIN b ON a.room = b.room WHERE b.flag = 'A'")
def room_furniture_rules(spark, folder):
    """Furniture against the box around its room's boundaries."""
    all_ = objects(spark, folder)
    low, high = ([F.col(f"{s}_{a}") for a in boxes.AXES] for s in ("min", "max"))
    rooms = spatial.extract_bbox(all_.where("flag = 'N'"), ["room"], low, high)
    rooms = rooms.select("room", *[F.col(c).alias(f"a_{c}") for c in spatial.BOX])
    furniture = all_.where("flag = 'A'").select("room", "id", *[F.col(c).alias(f"b_{c}") for c in spatial.BOX])
    return rooms.join(furniture, "room").select("room", "id", boxes.contains("a_", "b_").alias("inside"), boxes.touches_closed("a_", "b_").alias("adjacent"))


@query("connected_rooms", "SELECT DISTINCT least(a.l_orderkey, b.l_orderkey) AS a, greatest(a.l_orderkey, b.l_orderkey) AS b FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F') a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F') b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey")
def connected_rooms(spark, folder):
    """Rooms that share a door (a part bought by both)."""
    doors = read(spark, folder, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'").select("l_orderkey", "l_partkey").distinct()
    both = doors.select("l_partkey", F.col("l_orderkey").alias("source_id")).join(doors.select("l_partkey", F.col("l_orderkey").alias("target_id")), "l_partkey").where("source_id < target_id")
    return graph.connected(both)


_FAMILY_SQL = "CASE WHEN source_flag = 'A' AND target_flag = 'A' THEN 'furniture_furniture' WHEN source_flag = 'N' OR target_flag = 'N' THEN 'furniture_boundary_surface' ELSE 'furniture_opening' END"


@query("pair_family_stats", f"WITH {_R} SELECT {_FAMILY_SQL} AS family, count(*) AS candidates, count(relation) AS inferred, count(*) FILTER (relation = 'INTERSECTS') AS n_intersects, count(*) FILTER (relation = 'TOUCHES') AS n_touches, count(*) FILTER (relation = 'ADJACENT_TO') AS n_adjacent FROM r GROUP BY 1")
def pair_family_stats(spark, folder):
    kind = lambda side: F.when(F.col(f"{side}_flag") == "A", "BuildingFurniture").when(F.col(f"{side}_flag") == "R", "Opening").otherwise("BoundarySurface")
    family = boxes.pair_family(kind("source"), F.lit("Door"), kind("target"), F.lit("Door"))
    n = lambda r: F.count_if(F.coalesce(F.col("relation") == r, F.lit(False)))
    return relations(spark, folder).groupBy(family.alias("family")).agg(
        F.count("*").alias("candidates"), F.count("relation").alias("inferred"), n("INTERSECTS").alias("n_intersects"), n("TOUCHES").alias("n_touches"), n("ADJACENT_TO").alias("n_adjacent")
    )


_RATIO = "CASE WHEN {e} <= 0 THEN 1.0 ELSE least(CAST({a} AS DOUBLE) / {e}, 1.0) END"


@query("spatial_coverage", f"""WITH {_R}, rooms AS (
  SELECT room, count(*) FILTER (flag = 'A') AS f, count(*) FILTER (flag = 'N') AS b, count(*) FILTER (flag = 'R') AS o FROM b GROUP BY room
), e AS (SELECT CAST(sum(f * b * 2 + f * o * 2 + f * (f - 1)) AS BIGINT) AS candidates FROM rooms), i AS (SELECT count(*) AS inferred FROM r WHERE relation IS NOT NULL)
SELECT candidates, inferred, CAST(100 * {_RATIO.format(e='candidates', a='inferred')} AS DOUBLE) AS coverage FROM e, i""")
def spatial_coverage(spark, folder):
    rooms = objects(spark, folder).groupBy("room").agg(*[F.count_if(F.col("flag") == k).alias(n) for k, n in (("A", "f"), ("N", "b"), ("R", "o"))])
    expected = rooms.agg(F.sum(summary.candidate_pairs(rooms)).alias("candidates"))
    inferred = relations(spark, folder).where("relation is not null").agg(F.count("*").alias("inferred"))
    return expected.crossJoin(inferred).withColumn("coverage", scalar.safe_ratio(F.col("inferred"), F.col("candidates")) * 100)  # one row each


def inferred_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Every relation whose condition a pair meets, before precedence."""
    rows = candidates(spark, folder)
    d = boxes.distance("a_", "b_")
    met = F.array(
        F.when(boxes.intersects("a_", "b_", T.intersection), F.lit("INTERSECTS")), F.when(d <= T.touch, F.lit("TOUCHES")), F.when(d <= T.adjacent, F.lit("ADJACENT_TO"))
    )
    return rows.select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), F.col("a_flag").alias("source_flag"), F.col("b_flag").alias("target_flag"), F.posexplode(met).alias("ord", "relation")).where("relation is not null")


_MET = f"""{_B}, c AS (SELECT a.id AS source_id, b.id AS target_id, {_each(f'{_OVER} > 1e-6', ' AND ')} AS i, {_DIST} AS d {_PAIR}), met AS (
  SELECT source_id, target_id, 'INTERSECTS' AS relation, 3 AS rank FROM c WHERE i
  UNION ALL SELECT source_id, target_id, 'TOUCHES', 2 FROM c WHERE d <= 0.05
  UNION ALL SELECT source_id, target_id, 'ADJACENT_TO', 1 FROM c WHERE d <= 2.5
)"""


@query("spatial_precedence", f"WITH {_MET} SELECT source_id, target_id, relation FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY rank DESC) AS k FROM met) WHERE k = 1")
def spatial_precedence(spark, folder):
    return spatial.strongest(inferred_edges(spark, folder), ["source_id"]).select("source_id", "target_id", "relation")


@query("precision_sanity", f"""WITH {_MET}, pair AS (SELECT source_id, target_id, count(DISTINCT relation) AS n FROM met GROUP BY 1, 2)
SELECT count(*) AS pairs, count(*) FILTER (n = 1) AS single, CAST(100.0 * count(*) FILTER (n = 1) / count(*) AS DOUBLE) AS precedence_ratio FROM pair""")
def precision_sanity(spark, folder):
    """How many pairs would break precedence if nothing were normalised."""
    pair = inferred_edges(spark, folder).groupBy("source_id", "target_id").agg(F.count_distinct("relation").alias("n"))
    single = F.count_if(F.col("n") == 1)
    return pair.agg(F.count("*").alias("pairs"), single.alias("single"), (F.lit(100.0) * single / F.count("*")).alias("precedence_ratio"))


# ---------------------------------------------------------------- graph queries

def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One node an object, the last of its rows; rooms too."""
    p = points(spark, folder).select(F.lit("star").alias("doc_id"), "id", "node_type", F.col("x").alias("ord"), "opening_type")
    rooms = read(spark, folder, "orders").select(F.lit("star").alias("doc_id"), F.concat(F.lit("room_"), "o_orderkey").alias("id"), F.lit("Room").alias("node_type"), F.lit(0.0).alias("ord"), F.lit(None).cast("string").alias("opening_type"))
    each = p.groupBy("doc_id", "id", "node_type").agg(F.max("ord").alias("ord"), F.min("opening_type").alias("opening_type"))
    return each.unionByName(rooms)


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    inferred = relations(spark, folder).where("relation is not null").select(F.lit("star").alias("doc_id"), "source_id", "target_id", "relation")
    inside = objects(spark, folder).where("flag in ('A', 'R')").select(
        F.lit("star").alias("doc_id"), F.col("id").alias("source_id"), F.concat(F.lit("room_"), "room").alias("target_id"), F.when(F.col("flag") == "A", "INSIDE").otherwise("CONNECTS").alias("relation")
    )
    return inferred.unionByName(inside).withColumn("ord", F.lit(0))


def scene(spark: SparkSession, folder: str) -> graph.SceneGraph:
    return graph.SceneGraph(graph_nodes(spark, folder), graph_edges(spark, folder))


def _pattern(name: str, source: str, relation: str, target: str, where: str = "true"):
    flag = {v: k for k, v in FLAGS.items()}
    sql = f"WITH {_R} SELECT count(*) AS n FROM r WHERE relation = '{relation}' AND source_flag = '{flag[source]}' AND target_flag = '{flag[target]}' AND {where}"

    @query(name, sql)
    def run(spark, folder):
        return scene(spark, folder).match(source, relation, target).where(where).agg(F.count("*").alias("n"))


_pattern("q1_furniture_furniture_intersects", "BuildingFurniture", "INTERSECTS", "BuildingFurniture", "source_id < target_id")
_pattern("q2_furniture_opening_touches", "BuildingFurniture", "TOUCHES", "Opening")
_pattern("q3_furniture_boundary_adjacent", "BuildingFurniture", "ADJACENT_TO", "BoundarySurface")
_pattern("qx1_furniture_opening_intersects", "BuildingFurniture", "INTERSECTS", "Opening")
_pattern("qx1_furniture_boundary_touches", "BuildingFurniture", "TOUCHES", "BoundarySurface")
_pattern("qx1_furniture_furniture_adjacent", "BuildingFurniture", "ADJACENT_TO", "BuildingFurniture")


@query("q4_opening_connects_room", f"WITH {_B} SELECT count(*) AS n FROM b WHERE flag = 'R'")
def q4(spark, folder):
    return scene(spark, folder).match("Opening", "CONNECTS", "Room").agg(F.count("*").alias("n"))


@query("q5_inside_room_touching_opening", f"WITH {_R} SELECT count(DISTINCT source_id) AS n FROM r WHERE relation = 'TOUCHES' AND source_flag = 'A' AND target_flag = 'R'")
def q5(spark, folder):
    g = scene(spark, folder)
    inside = g.match("BuildingFurniture", "INSIDE", "Room").select(F.col("source_id").alias("f"), F.col("target_id").alias("room"))
    connects = g.match("Opening", "CONNECTS", "Room").select(F.col("source_id").alias("o"), F.col("target_id").alias("room"))
    touches = g.match("BuildingFurniture", "TOUCHES", "Opening").select(F.col("source_id").alias("f"), F.col("target_id").alias("o"))
    return touches.join(inside, "f").join(connects, ["o", "room"]).agg(F.count_distinct("f").alias("n"))


@query("adjacent_not_touching", f"WITH {_R} SELECT source_id, target_id FROM r WHERE relation = 'ADJACENT_TO' AND source_flag = 'A' AND target_flag = 'R'")
def adjacent_not_touching(spark, folder):
    return scene(spark, folder).match("BuildingFurniture", "ADJACENT_TO", "Opening").select("source_id", "target_id")


@query("opening_type_distribution", f"WITH {_P}, o AS (SELECT id, room, min(opening_type) AS opening_type FROM p WHERE flag = 'R' GROUP BY id, room) SELECT room, count(*) FILTER (opening_type = 'Door') AS doors, count(*) FILTER (opening_type = 'Window') AS windows FROM o GROUP BY room")
def opening_type_distribution(spark, folder):
    openings = points(spark, folder).where("flag = 'R'").groupBy("id", "room").agg(F.min("opening_type").alias("opening_type"))
    return openings.groupBy("room").agg(F.count_if(F.col("opening_type") == "Door").alias("doors"), F.count_if(F.col("opening_type") == "Window").alias("windows"))


@query("top_n_adjacent_per_room", f"WITH {_R}, c AS (SELECT room, source_id, count(*) AS n FROM r WHERE relation = 'ADJACENT_TO' AND source_flag = 'A' GROUP BY room, source_id) SELECT room, source_id, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY n DESC, source_id) AS place FROM c) WHERE place <= 3")
def top_n_adjacent_per_room(spark, folder):
    counts = relations(spark, folder).where("relation = 'ADJACENT_TO' and source_flag = 'A'").groupBy("room", "source_id").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("room").orderBy(F.desc("n"), "source_id"))).where("place <= 3")


# ---------------------------------------------------------------- construction

@query("fallback_ids", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat(lower(role), '_', row_number() OVER (PARTITION BY role, turn % 2 ORDER BY conv_id, turn, text)) ELSE concat('gml_', conv_id, '_', turn) END AS id FROM conversations")
def fallback_ids(spark, folder):
    """Even turns have no id of their own."""
    rows = read(spark, folder, "conversations").withColumn("given", F.when(F.col("turn") % 2 != 0, F.concat_ws("_", F.lit("gml"), "conv_id", "turn")))
    return graph.fallback_ids(rows, "role", ["conv_id", "turn", "text"], "given", []).select("conv_id", "turn", "id")


@query("ring_sequence_ids", "SELECT conv_id, turn, concat('ring:', conv_id, '_ring_', row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1) AS id FROM conversations")
def ring_sequence_ids(spark, folder):
    rows = read(spark, folder, "conversations")
    return rows.select("conv_id", "turn", F.concat(F.lit("ring:"), "conv_id", F.lit("_ring_"), tree.ring_sequence(rows, ["conv_id"], ["turn", "text"])).alias("id"))


@query("prefixed_ids", "SELECT s_suppkey, concat('polygon:', s_name) AS polygon_id, concat('geometry:solid:', s_name) AS geometry_id, concat('boundary_surface_type::', coalesce(nullif(trim(s_name), ''), 'BoundarySurface')) AS type_id FROM supplier")
def prefixed_ids(spark, folder):
    name = F.col("s_name")
    return read(spark, folder, "supplier").select("s_suppkey", F.concat(F.lit("polygon:"), name).alias("polygon_id"), F.concat(F.lit("geometry:solid:"), name).alias("geometry_id"), scalar.type_node_id(scalar.surface_type(name)).alias("type_id"))


@query("node_upsert_last_wins", """WITH k AS (SELECT *, row_number() OVER w AS last_, min(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS first_ord
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_returnflag DESC))
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, first_ord FROM k WHERE last_ = 1""")
def node_upsert_last_wins(spark, folder):
    rows = read(spark, folder, "lineitem")
    kept = graph.last_wins(rows, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_returnflag"])
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "first_ord")


@query("edge_dedup_first_wins", """SELECT l_orderkey, l_partkey, l_returnflag, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_partkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1""")
def edge_dedup_first_wins(spark, folder):
    kept = graph.first_wins(read(spark, folder, "lineitem"), ["l_orderkey", "l_returnflag", "l_partkey"], ["l_linenumber", "l_quantity", "l_extendedprice"])
    return kept.select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice")


_VALUES = ", ".join(f"('{s}', '{r}', '{t}')" for s, r, t in schema.TRIPLES)
#: Edges to be judged: order priority picks a relation.
_RAW_SQL = f"""{_P}, nodes AS (SELECT DISTINCT id, node_type FROM p UNION ALL SELECT concat('room_', o_orderkey), 'Room' FROM orders),
allowed(source_type, relation, target_type) AS (VALUES {_VALUES}), raw AS (
  SELECT DISTINCT p.id AS source_id, concat('room_', p.room) AS target_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'INSIDE' WHEN '2-HIGH' THEN 'CONNECTS' ELSE 'HAS_OPENING' END AS relation
  FROM p JOIN orders ON o_orderkey = p.room
), judged AS (
  SELECT raw.*, s.node_type AS source_type, t.node_type AS target_type,
         CASE WHEN s.id IS NULL THEN 'missing source' WHEN t.id IS NULL THEN 'missing target' WHEN a.relation IS NULL THEN 'illegal triple' END AS reason
  FROM raw LEFT JOIN nodes s ON s.id = source_id LEFT JOIN nodes t ON t.id = target_id
  LEFT JOIN allowed a ON a.source_type = s.node_type AND a.relation = raw.relation AND a.target_type = t.node_type
)"""


def _raw_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    p, orders = points(spark, folder), read(spark, folder, "orders")
    nodes = p.select("id", "node_type").distinct().unionByName(orders.select(F.concat(F.lit("room_"), "o_orderkey").alias("id"), F.lit("Room").alias("node_type")))
    relation = F.when(F.col("o_orderpriority") == "1-URGENT", "INSIDE").when(F.col("o_orderpriority") == "2-HIGH", "CONNECTS").otherwise("HAS_OPENING")
    edges = p.join(orders, F.col("o_orderkey") == F.col("room")).select(F.col("id").alias("source_id"), F.concat(F.lit("room_"), "room").alias("target_id"), relation.alias("relation")).distinct()
    return nodes.withColumn("doc_id", F.lit("star")), edges.withColumn("doc_id", F.lit("star")).withColumn("ord", F.lit(0))


@query("allowed_triple_filter", f"WITH {_RAW_SQL} SELECT source_id, relation, target_id FROM judged WHERE reason IS NULL")
def allowed_triple_filter(spark, folder):
    nodes, edges = _raw_graph(spark, folder)
    return graph.add_edges(edges, nodes)[0].select("source_id", "relation", "target_id")


@query("rejected_edges", f"WITH {_RAW_SQL} SELECT source_id, relation, target_id, reason FROM judged WHERE reason IS NOT NULL")
def rejected_edges(spark, folder):
    nodes, edges = _raw_graph(spark, folder)
    return graph.add_edges(edges, nodes)[1].select("source_id", "relation", "target_id", "reason")


@query("validate_graph", """WITH e AS (SELECT l_orderkey AS source_id, l_returnflag AS relation, l_suppkey + 1000000000 AS target_id FROM lineitem), n AS (SELECT o_orderkey AS id FROM orders UNION ALL SELECT p_partkey + 1000000000 FROM part)
SELECT 'missing source' AS problem, source_id, relation, target_id FROM e WHERE source_id NOT IN (SELECT id FROM n)
UNION ALL SELECT 'missing target', source_id, relation, target_id FROM e WHERE target_id NOT IN (SELECT id FROM n)
UNION ALL SELECT 'repeated edge', source_id, relation, target_id FROM e GROUP BY ALL HAVING count(*) > 1""")
def validate_graph(spark, folder):
    """Edges from orders to suppliers, on a graph of orders and parts: ends that exist by chance, and repeated edges."""
    far = F.lit(1_000_000_000)
    edges = read(spark, folder, "lineitem").select(F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("source_id"), F.col("l_returnflag").alias("relation"), (F.col("l_suppkey") + far).alias("target_id"))
    nodes = read(spark, folder, "orders").select(F.lit(1).alias("doc_id"), F.col("o_orderkey").alias("id")).unionByName(read(spark, folder, "part").select(F.lit(1).alias("doc_id"), (F.col("p_partkey") + far).alias("id")))
    return graph.validate(nodes, edges).drop("doc_id")


@query("edge_index", "SELECT l_orderkey AS source_id, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS targets FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def edge_index(spark, folder):
    edges = read(spark, folder, "lineitem").select(F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("relation"))
    return graph.edge_index(edges, "A").select("source_id", F.array_join(F.transform("targets", lambda t: t.cast("string")), ",").alias("targets"))


@query("gml_id_index", "SELECT trim(p_name) AS gml_id, count(*) AS n_nodes, min(concat('solid:', p_partkey)) AS first_node FROM part GROUP BY 1")
def gml_id_index(spark, folder):
    nodes = read(spark, folder, "part").select(F.lit(1).alias("doc_id"), F.col("p_name").alias("gml_id"), F.concat(F.lit("solid:"), "p_partkey").alias("id"))
    return graph.id_index(nodes).select("gml_id", F.size("node_ids").cast("long").alias("n_nodes"), F.col("node_ids")[0].alias("first_node"))


# ---------------------------------------------------------------- hierarchy

_CHAIN = """e(source_id, target_id) AS (
  SELECT DISTINCT concat('region_', n_regionkey), concat('nation_', n_nationkey) FROM nation
  UNION ALL SELECT DISTINCT concat('nation_', c_nationkey), concat('customer_', c_custkey) FROM customer
  UNION ALL SELECT DISTINCT concat('customer_', o_custkey), concat('order_', o_orderkey) FROM orders
)"""


def chain(spark: SparkSession, folder: str) -> DataFrame:
    """CONTAINS edges of region, nation, customer and order."""
    edge = lambda table, a, x, b, y: read(spark, folder, table).select(F.concat(F.lit(f"{a}_"), x).alias("source_id"), F.concat(F.lit(f"{b}_"), y).alias("target_id")).distinct()
    return (
        edge("nation", "region", "n_regionkey", "nation", "n_nationkey")
        .unionByName(edge("customer", "nation", "c_nationkey", "customer", "c_custkey"))
        .unionByName(edge("orders", "customer", "o_custkey", "order", "o_orderkey"))
    )


@query("descendants_closure", f"""WITH RECURSIVE {_CHAIN}, d(start, node) AS (
  SELECT source_id, target_id FROM e WHERE source_id LIKE 'region%' UNION SELECT d.start, e.target_id FROM d JOIN e ON d.node = e.source_id
) SELECT start, split_part(node, '_', 1) AS kind, count(*) AS n FROM d GROUP BY 1, 2""")
def descendants_closure(spark, folder):
    starts = read(spark, folder, "region").select(F.concat(F.lit("region_"), "r_regionkey").alias("start"))
    found = graph.closure(chain(spark, folder), starts)
    return found.groupBy("start", F.substring_index("node", "_", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("building_breakdown", """SELECT r_name, count(DISTINCT n_nationkey) AS parts, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS rooms,
  count(DISTINCT CASE WHEN l_returnflag = 'A' THEN concat(l_orderkey, '_', l_linenumber) END) AS furniture, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN concat(l_orderkey, '_', l_linenumber) END) AS openings,
  count(DISTINCT CASE WHEN l_returnflag = 'N' THEN concat(l_orderkey, '_', l_linenumber) END) AS surfaces
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name""")
def building_breakdown(spark, folder):
    """Distinct counts a building: objects are made distinct by id first, so the counts add up level by level."""
    li = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    per_room = li.groupBy("l_orderkey").agg(*[F.count_if(F.col("l_returnflag") == k).alias(n) for k, n in (("A", "furniture"), ("R", "openings"), ("N", "surfaces"))])
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey").join(per_room, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    names = ("furniture", "openings", "surfaces")
    per_customer = orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("rooms"), *[F.sum(n).alias(n) for n in names])
    customers = read(spark, folder, "customer").join(per_customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    per_nation = customers.groupBy("c_nationkey").agg(F.count("c_custkey").alias("customers"), *[F.sum(n).alias(n) for n in ("rooms", *names)])
    nations = read(spark, folder, "nation").join(per_nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    joined = read(spark, folder, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).alias(n)
    return joined.groupBy("r_name").agg(F.count("n_nationkey").alias("parts"), *[total(n) for n in ("customers", "rooms", *names)])


def path_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as elements with their ancestors, outermost first."""
    anc = F.array(*[F.struct(F.col(k).cast("long").alias("eid"), F.lit(t).alias("tag")) for k, t in (("r_regionkey", "CityModel"), ("n_nationkey", "Building"), ("c_custkey", "Room"))])
    joined = (
        read(spark, folder, "orders").join(read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(F.col("o_orderkey").alias("eid"), F.when(F.col("o_orderkey") % 3 == 0, F.slice(anc, 1, 2)).otherwise(anc).alias("anc"))


_PATH = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query("nearest_ancestor", f"SELECT o_orderkey AS eid, CASE WHEN o_orderkey % 3 = 0 THEN CAST(n_nationkey AS BIGINT) ELSE c_custkey END AS owner, CASE WHEN o_orderkey % 3 = 0 THEN 'Building' ELSE 'Room' END AS owner_type FROM {_PATH}")
def nearest_ancestor(spark, folder):
    found = tree.nearest(F.col("anc"), ["Building", "Room"])
    return path_elements(spark, folder).select("eid", found["eid"].alias("owner"), found["tag"].alias("owner_type"))


@query("direct_parent_tag", f"SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Building' ELSE 'Room' END AS parent, count(*) AS n FROM {_PATH} GROUP BY 1")
def direct_parent_tag(spark, folder):
    return path_elements(spark, folder).groupBy(tree.direct_parent_tag(F.col("anc")).alias("parent")).agg(F.count("*").alias("n"))


@query("first_descendant", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority, min(o_orderkey) FILTER (o_orderstatus = 'F') AS first_finished FROM orders GROUP BY 1")
def first_descendant(spark, folder):
    """First in document order below a parent, with and without a condition."""
    return read(spark, folder, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("first_finished"))


# ---------------------------------------------------------------- appearance

# ---------------------------------------------------------------- scalars

_KEY_SQL = "coalesce(nullif(lower(trim(regexp_replace(regexp_replace({c}, '[^0-9A-Za-z_]+', '_', 'g'), '_+', '_', 'g'), '_')), ''), 'unnamed')"


@query("sanitize_keys", f"SELECT p_partkey, {_KEY_SQL.format(c='trim(p_name)')} AS k_name, {_KEY_SQL.format(c='trim(p_type)')} AS k_type FROM part")
def sanitize_keys(spark, folder):
    return read(spark, folder, "part").select("p_partkey", scalar.sanitize_key(F.col("p_name")).alias("k_name"), scalar.sanitize_key(F.col("p_type")).alias("k_type"))


@query("parse_numeric", """WITH t AS (SELECT event_id, trim(CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN concat(' ', user_id, '.5 ') WHEN 2 THEN event_type ELSE concat('-', user_id, 'e2') END) AS t FROM events)
SELECT event_id, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN CAST(t AS BIGINT) END AS v_int,
  CASE WHEN NOT regexp_full_match(t, '[+-]?[0-9]+') THEN TRY_CAST(t AS DOUBLE) END AS v_dbl, CASE WHEN TRY_CAST(t AS DOUBLE) IS NULL THEN t END AS v_str FROM t""")
def parse_numeric(spark, folder):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.concat(F.lit(" "), "user_id", F.lit(".5 "))).when(k == 2, F.col("event_type")).otherwise(F.concat(F.lit("-"), "user_id", F.lit("e2")))
    return read(spark, folder, "events").select("event_id", scalar.parse_numeric(text).alias("v")).select("event_id", "v.v_int", "v.v_dbl", "v.v_str")


@query("generic_attributes_eav", """WITH a AS (SELECT user_id, concat('attr_', lower(event_type)) AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v, event_id FROM events)
SELECT user_id, key, arg_max(v, event_id) AS value, count(*) AS n FROM a GROUP BY 1, 2""")
def generic_attributes_eav(spark, folder):
    """Attribute rows of owners, the last of a name wins."""
    key = F.concat(F.lit("attr_"), scalar.sanitize_key(F.col("event_type")))
    rows = read(spark, folder, "events").select("user_id", key.alias("key"), F.get_json_object("props", "$.k").try_cast("long").alias("v"), "event_id")
    return rows.groupBy("user_id", "key").agg(F.max_by("v", "event_id").alias("value"), F.count("*").alias("n"))


@query("parse_pos_list", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(2 AS BIGINT) AS n_positions, CAST(l_quantity AS DOUBLE) AS x, CAST(l_partkey AS DOUBLE) AS y, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_suppkey END AS DOUBLE) AS z
FROM lineitem""")
def parse_pos_list(spark, folder):
    """Two positions of two or three numbers each, by dimension."""
    even = F.col("l_linenumber") % 2 == 0
    pair, triple = F.concat_ws(" ", "l_quantity", "l_partkey"), F.concat_ws(" \n", "l_quantity", "l_partkey", "l_suppkey")
    one = F.when(even, pair).otherwise(triple)
    parsed = scalar.parse_pos_list(F.concat(F.lit(" "), one, F.lit("  "), one), F.when(even, F.lit("2")))
    # a list of two pairs has four numbers, which dimension 2 divides; one of two triples has six
    rows = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", parsed.alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.size("p").cast("long").alias("n_positions"), F.col("p")[0][0].alias("x"), F.col("p")[0][1].alias("y"), F.col("p")[0][2].alias("z"))


@query("target_refs", "SELECT p_partkey, concat(replace(p_brand, '#', ''), '|', p_partkey) AS refs FROM part")
def target_refs(spark, folder):
    refs = scalar.target_refs(F.concat(F.lit(" doc#"), F.regexp_replace("p_brand", "#", ""), F.lit("  #"), "p_partkey", F.lit(" # ")))
    return read(spark, folder, "part").select("p_partkey", F.array_join(refs, "|").alias("refs"))


@query("safe_label", "WITH x AS (SELECT p_partkey, regexp_replace(CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END, '[^0-9A-Za-z_]', '_', 'g') AS x FROM part) SELECT p_partkey, CASE WHEN x = '' THEN 'UnknownType' WHEN regexp_matches(x, '^[0-9]') THEN concat('N_', x) ELSE x END AS label FROM x")
def safe_label(spark, folder):
    text = F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.col("p_brand"))
    return read(spark, folder, "part").select("p_partkey", scalar.safe_label(text).alias("label"))


@query("local_name", "SELECT s_suppkey, s_name AS tag, s_name AS href FROM supplier")
def local_name(spark, folder):
    return read(spark, folder, "supplier").select("s_suppkey", scalar.local_name(F.concat(F.lit("{http://example.org/ns}"), "s_name")).alias("tag"), scalar.resolve_xlink(F.concat(F.lit("##"), "s_name")).alias("href"))


@query("progress_bars", "WITH k AS (SELECT c_custkey, CAST(round_even(least(greatest(c_acctbal / 10000.0, 0.0), 1.0) * 20, 0) AS INTEGER) AS k FROM customer) SELECT c_custkey, concat(repeat('#', k), repeat('-', 20 - k)) AS bar FROM k")
def progress_bars(spark, folder):
    return read(spark, folder, "customer").select("c_custkey", scalar.bar(F.col("c_acctbal"), F.lit(10000.0), 20).alias("bar"))


@query("format_counter", "SELECT c_nationkey, string_agg(concat(c_mktsegment, '=', n), ', ' ORDER BY c_mktsegment) AS line FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def format_counter(spark, folder):
    counts = read(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return counts.groupBy("c_nationkey").agg(scalar.counter_text("c_mktsegment", "n").alias("line"))


@query("read_dotted_path", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, 0.0::DOUBLE AS missing FROM events")
def read_dotted_path(spark, folder):
    return read(spark, folder, "events").select("event_id", scalar.read_path(F.col("props"), "k").alias("k"), scalar.read_path(F.col("props"), "a.b").alias("missing"))


@query("furniture_validation", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CASE WHEN l_quantity <= 25 THEN 1 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors FROM lineitem GROUP BY 1, 2")
def furniture_validation(spark, folder):
    errors = scalar.furniture_errors(F.col("l_quantity") > 25, F.lit("id"), F.when(F.col("l_linestatus") == "F", F.lit("room")))
    return read(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.size(errors)).cast("long").alias("n_errors"))


# ---------------------------------------------------------------- summaries

@query("node_type_counts", f"WITH {_P} SELECT node_type, count(DISTINCT id) AS n FROM p GROUP BY 1")
def node_type_counts(spark, folder):
    return summary.count_by(points(spark, folder).select("id", "node_type").distinct(), "node_type")


@query("relation_counts", f"WITH {_R}, all_ AS (SELECT relation FROM r WHERE relation IS NOT NULL UNION ALL SELECT CASE flag WHEN 'A' THEN 'INSIDE' ELSE 'CONNECTS' END FROM b WHERE flag IN ('A', 'R')) SELECT relation, count(*) AS n FROM all_ GROUP BY 1")
def relation_counts(spark, folder):
    return summary.count_by(graph_edges(spark, folder), "relation")


@query("appearance_coverage", "SELECT count(DISTINCT d.doc_id) AS total, count(DISTINCT l.doc_id) AS linked, 100.0 * count(DISTINCT l.doc_id) / count(DISTINCT d.doc_id) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def appearance_coverage(spark, folder):
    docs, linked = read(spark, folder, "documents").select("doc_id").distinct(), read(spark, folder, "labels").select("doc_id", F.lit(1).alias("linked")).distinct()
    rows = docs.join(linked, "doc_id", "left")
    return rows.agg(F.count("*").alias("total"), F.count("linked").alias("linked"), (F.lit(100.0) * F.count("linked") / F.count("*")).alias("coverage"))


@query("density_stats", "SELECT o_orderpriority, avg(n) AS avg_n, max(n) AS max_n FROM (SELECT o_orderpriority, l_orderkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1")
def density_stats(spark, folder):
    rows = read(spark, folder, "lineitem").join(read(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return summary.density(rows, ["l_orderkey"], ["o_orderpriority"])


@query("property_coverage", "SELECT count(*) AS expected, count(*) FILTER (c_acctbal > 0) + 0 AS actual, CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) / count(*) AS coverage FROM customer")
def property_coverage(spark, folder):
    rows = read(spark, folder, "customer").agg(F.count("*").alias("expected"), F.count_if(F.col("c_acctbal") > 0).alias("actual"))
    return rows.withColumn("coverage", scalar.safe_ratio(F.col("actual"), F.col("expected")))


_COUNTS = "c AS (SELECT l_returnflag AS relation, count(*) FILTER (l_linestatus = 'F') AS expected, count(*) FILTER (l_quantity > 26) AS actual FROM lineitem GROUP BY 1)"


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("relation")).agg(F.count_if(F.col("l_linestatus") == "F").alias("expected"), F.count_if(F.col("l_quantity") > 26).alias("actual"))


@query("relation_coverage", f"WITH {_COUNTS} SELECT round(avg(least(CAST(actual AS DOUBLE) / expected, 1.0)), 12) AS coverage, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual FROM c WHERE expected > 0")
def relation_coverage(spark, folder):
    return summary.relation_coverage(_counts(spark, folder)).withColumn("coverage", F.round("coverage", 12))


@query("overall_score", f"WITH {_COUNTS}, s AS (SELECT avg(least(CAST(actual AS DOUBLE) / expected, 1.0)) AS r FROM c), p AS (SELECT CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) / count(*) AS p FROM customer) SELECT round((1.0 * 0.40 + r * 0.30 + p * 0.30) * 100, 2)::DOUBLE AS overall FROM s, p")
def overall_score(spark, folder):
    both = summary.relation_coverage(_counts(spark, folder)).select(F.col("coverage").alias("r")).crossJoin(property_coverage(spark, folder).select(F.col("coverage").alias("p")))
    return both.select(summary.overall(F.lit(1.0), F.col("r"), F.col("p")).alias("overall"))


@query("profile_stats", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def profile_stats(spark, folder):
    rows = summary.profile(read(spark, folder, "events"), ["event_type"], "value")
    return rows.withColumn("avg", F.round("avg", 6)).withColumn("std", F.round("std", 6))


_BASELINE = [("A", 1.0, None), ("N", None, 10.0), ("R", 100.0, 1e12), ("X", 0.0, None)]


@query("baseline_check", "WITH a AS (SELECT l_returnflag AS metric, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1), b(metric, least, most) AS (VALUES ('A', 1.0, NULL), ('N', NULL, 10.0), ('R', 100.0, 1e12), ('X', 0.0, NULL)) SELECT metric, coalesce(value, -1.0)::DOUBLE AS value, coalesce(coalesce(value, -1) >= b.least, true) AND coalesce(coalesce(value, -1) <= b.most, true) AS ok FROM b LEFT JOIN a USING (metric)")
def baseline_check(spark, folder):
    actual = read(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return summary.check_baseline(actual, spark.createDataFrame(_BASELINE, "metric string, least double, most double")).select("metric", "value", "ok")


# ---------------------------------------------------------------- sinks

@query("upsert_merge_props", """WITH u AS (SELECT c_custkey AS id, c_mktsegment AS segment, CAST(c_acctbal AS VARCHAR) AS balance, NULL AS note, 0 AS ord FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'NEW' END, NULL, c_name, 1 FROM customer)
SELECT id, arg_max(segment, ord) FILTER (segment IS NOT NULL) AS segment, max(balance) AS balance, max(note) AS note FROM u GROUP BY 1""")
def upsert_merge_props(spark, folder):
    """New maps of properties merge into old ones entry by entry; a null entry leaves the old value."""
    from plinth.sources.store import merge_properties

    rows = read(spark, folder, "customer").withColumn("id", F.col("c_custkey"))
    old = rows.select("id", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("balance"), F.col("c_acctbal").cast("string")).alias("props"))
    new = rows.select("id", F.create_map(F.lit("segment"), F.when(F.col("c_acctbal") >= 0, "NEW"), F.lit("note"), F.col("c_name")).alias("props"))
    return merge_properties(old, new, ["id"]).select("id", *[F.col("props")[k].alias(k) for k in ("segment", "balance", "note")])


@query("batch_chunks", "SELECT l_returnflag AS label, CAST(floor((row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1) / 5000) AS BIGINT) AS batch FROM lineitem")
def batch_chunks(spark, folder):
    from plinth.sources.store import chunks

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return chunks(read(spark, folder, "lineitem"), ["l_returnflag"], order, 5000).select(F.col("l_returnflag").alias("label"), "batch")
