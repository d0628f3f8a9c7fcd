"""Tree operators over element tables.

elements: doc_id, eid (pre-order), end_eid, parent_eid, depth, tag, ns, text,
attrs, anc (structs of eid and tag, outermost first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(anc: Column, tags: list[str]) -> Column:
    """The innermost ancestor with one of the tags, as struct(eid, tag)."""
    return F.get(F.reverse(F.filter(anc, lambda a: a["tag"].isin(*tags))), F.lit(0))


def direct_parent_tag(anc: Column) -> Column:
    return F.get(anc, F.size(anc) - 1)["tag"]


def nearest_matching(anc: Column, pattern: str) -> Column:
    """The innermost ancestor whose tag matches a pattern."""
    return F.get(F.reverse(F.filter(anc, lambda a: a["tag"].rlike(pattern))), F.lit(0))


def children(elements: DataFrame, parents: DataFrame) -> DataFrame:
    """parent_eid with its children as structs in document order; parents: doc_id, eid."""
    rows = elements.select("doc_id", F.col("parent_eid").alias("eid"), F.struct("eid", "tag", "text", "attrs").alias("child"))
    return rows.join(parents.select("doc_id", "eid"), ["doc_id", "eid"]).groupBy("doc_id", "eid").agg(F.sort_array(F.collect_list(F.struct(F.col("child.eid").alias("o"), F.col("child.tag").alias("tag"), F.col("child.text").alias("text")))).alias("children"))


def descendants(elements: DataFrame, roots: DataFrame, include_self: bool = True) -> DataFrame:
    """root_eid with every element below it: ancestors are exploded, so the join is an equi-join."""
    up = F.concat("anc", F.array(F.struct(F.col("eid"), F.col("tag")))) if include_self else F.col("anc")
    rows = elements.withColumn("up", F.explode(up)).withColumn("root_eid", F.col("up.eid")).drop("up")
    return rows.join(roots.select("doc_id", F.col("eid").alias("root_eid")), ["doc_id", "root_eid"])


def subtree_sizes(elements: DataFrame, roots: DataFrame, tags: list[str]) -> DataFrame:
    """doc_id, root_eid and n, the elements at and below it; tags: those that a root can have.

    Elements are counted where they are, and only the counts meet the roots.
    """
    up = F.filter(F.concat("anc", F.array(F.struct(F.col("eid"), F.col("tag")))), lambda a: a["tag"].isin(*tags))
    sizes = elements.select("doc_id", F.explode(F.transform(up, lambda a: a["eid"])).alias("root_eid")).groupBy("doc_id", "root_eid").agg(F.count("*").alias("n"))
    return sizes.join(roots.select("doc_id", F.col("eid").alias("root_eid")), ["doc_id", "root_eid"], "left_semi")


def first_text(elements: DataFrame, roots: DataFrame, names: dict[str, str]) -> DataFrame:
    """Per root the first non-empty text below it of each tag (any case): columns named by ``names``."""
    below = descendants(elements, roots).withColumn("t", F.trim("text")).where("t <> ''")
    pick = lambda tag: F.min_by("t", F.when(F.lower("tag") == tag.lower(), F.col("eid")))
    return below.groupBy("doc_id", F.col("root_eid").alias("eid")).agg(*[F.when(F.count_if(F.lower("tag") == tag.lower()) > 0, pick(tag)).alias(out) for tag, out in names.items()])


def ring_sequence(rows: DataFrame, owner: list[str], order: list[str]) -> Column:
    """0-based place among an owner's rows."""
    return F.row_number().over(Window.partitionBy(*owner).orderBy(*order)) - 1
