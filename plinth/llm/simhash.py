"""SimHash near-duplicates by segment-popcount embedding.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its 4-word
shingles.  Fingerprints that differ in at most ``RADIUS`` bits are linked, and a
class is a connected component of links.

Search.  A fingerprint is embedded as 32 counts, the set bits of each 2-bit
segment.  The Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints.  The 32 axes are cut into groups; if the Manhattan
distance is at most 4, all but 4 groups agree exactly, so a pair shares a grid cell
for one choice of groups to agree on.  Pairs of a cell are kept by the Manhattan
bound and then verified on the fingerprints.  More groups make finer cells and more
postings; ``group_count`` takes the number at which both together are least, so that
pairs do not grow with the square of the fingerprints.  It never changes a result.

Dense cells.  Equal fingerprints are one node.  Nodes at most 2 bits apart share
a neighbour within 1 bit, so 65 keys a node link them without any pair being
formed.  Only pairs across those classes are formed in cells, and cells that hold
one class are dropped before the join.  No cell or partner is capped.

Null and empty texts have fingerprint zero and are linked like any other.  A
repeated row repeats its result.  Null ids never become a component's id unless
the whole component has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, named, text_steps

SHINGLE = 4
SEED = 42
RADIUS = 4
_STEP = 1 << 14


def fingerprint(words: list[bytes]) -> int:
    """Majority bits of the hashes of all shingles of (lower-cased) words; repeats count."""
    import xxhash

    if not words:
        return 0
    line, digest, at = b" ".join(words), xxhash.xxh64_intdigest, [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    n = max(1, len(words) - SHINGLE + 1)
    ends = at[SHINGLE:] if len(words) >= SHINGLE else at[-1:]
    hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip(at, ends)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _STEP):
        bits = np.unpackbits(hashes[k : k + _STEP].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        # eight counters a word: no byte overflows within 255 rows
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        ones += sums.view(np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """keep and ``fp``, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for first, last, data, bounds in text_steps(batch.column("text")):
            raw, b = data.tobytes().lower(), bounds.tolist()
            found = [fingerprint(raw[x:y].split()) for x, y in zip(b[:-1], b[1:])]
            yield {"keep": batch.column("keep")[first:last], "fp": np.array(found, np.uint64).view(np.int64)}

    kind = docs.schema[keep].dataType.simpleString()
    return map_batches(docs.select(named(keep).alias("keep"), named(text).alias("text")), run, f"keep {kind}, fp long").withColumnRenamed("keep", keep)


_EVEN = 0x5555555555555555
#: Members of a cell above which classes of close fingerprints are formed first.
DENSE = 256


def embedding(fp: Column) -> Column:
    """Set bits of each 2-bit segment, in unary: bit 0 for one or two, bit 1 for two.

    The Manhattan distance of two count vectors is the Hamming distance of these.
    """
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(_EVEN))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(_EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_masks(groups: int) -> list[int]:
    """The 32 segments cut into groups of nearly equal size, as bit masks."""
    ends = [round(32 * k / groups) for k in range(groups + 1)]
    return [sum(3 << 2 * i for i in range(a, b)) for a, b in zip(ends, ends[1:])]


def group_count(n: int, radius: int = RADIUS) -> int:
    """The number of groups with the least postings and chance pairs a node, n nodes in all.

    The count of a 2-bit segment carries 1.5 bits, so g of m groups tell 2**(48 g / m) cells apart.
    """
    cost = lambda m: comb(m, radius) * (1 + n / 2 ** (48 * (m - radius) / m))
    return min(range(radius + 2, 33), key=cost)


def postings(nodes: DataFrame, radius: int, groups: int) -> DataFrame:
    """(key, fp): a row for each choice of groups - radius groups that may agree, key a hash of the choice and its cell.

    Two cells under one key only add pairs to verify.
    """
    choices = [_signed(sum(c)) for c in combinations(group_masks(groups), groups - radius)]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("e").bitwiseAND(F.lit(m))) for k, m in enumerate(choices)]))
    return nodes.select("fp", embedding(F.col("fp")).alias("e")).select(keys.alias("key"), "fp")


def shared_cells(posted: DataFrame) -> DataFrame:
    """The postings of cells with several members, and n, their number; postings are dealt once, for the count and for its join."""
    dealt = posted.repartition("key")
    # both ends are asked for, so that the count reads the same columns and hence the same exchange
    counts = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    return dealt.join(counts.where("lo < hi").select("key", "n"), "key")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _close_pairs(left: DataFrame, on: list[str], apart: Column, radius: int) -> DataFrame:
    right = left.select(*on, *[F.col(c).alias(f"{c}_") for c in left.columns if c not in on])
    bound = F.bit_count(embedding(F.col("fp")).bitwiseXOR(embedding(F.col("fp_")))) <= radius
    return left.join(right, on).where(apart & bound & (_distance("fp", "fp_") <= radius)).select(F.col("fp").alias("a"), F.col("fp_").alias("b"))


def _near_classes(nodes: DataFrame) -> DataFrame:
    """node, root: classes joined by steps of at most 2 bits, by 65 keys a node and no pairs."""
    from .graph import components

    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)) for k in range(64)])
    keys = nodes.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    least = keys.groupBy("key").agg(F.min("fp").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    return components(keys.join(least, "key").select(F.col("fp").alias("a"), F.col("first").alias("b")))


def links(nodes: DataFrame, radius: int = RADIUS, groups: int | None = None, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of fingerprints whose components are those of all pairs within radius.

    nodes: distinct fingerprints ``fp``.  In cells of up to ``dense`` members every
    pair within radius is there; in larger ones links inside a class of close
    fingerprints (steps of 2 bits or less) stand for its pairs.
    """
    cell = ["key"]
    shared = cut(shared_cells(postings(nodes, radius, groups or group_count(nodes.count(), radius))))
    found = _close_pairs(shared.where(F.col("n") <= dense).drop("n"), cell, F.col("fp") < F.col("fp_"), radius)
    crowded = shared.where(F.col("n") > dense)
    if radius >= 2 and crowded.head(1):
        classes = cut(_near_classes(crowded.select("fp").distinct()))
        members = crowded.drop("n").join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        mixed = members.groupBy(*cell).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(*cell)
        across = _close_pairs(members.join(mixed, cell), cell, F.col("root") < F.col("root_"), radius)
        found = found.unionByName(across).unionByName(classes.select(F.col("node").alias("a"), F.col("root").alias("b")))
    elif radius < 2:
        found = found.unionByName(_close_pairs(crowded.drop("n"), cell, F.col("fp") < F.col("fp_"), radius))
    return found


def near_duplicates(docs: DataFrame, text: str = "text", keep: str = "doc_id", radius: int = RADIUS, groups: int | None = None, dense: int = DENSE) -> DataFrame:
    """keep, fp, fingerprint (16 hex digits) and component_id, the least ``keep`` of the class."""
    from .graph import components

    marked = cut(fingerprints(docs, text, keep))
    nodes = cut(marked.groupBy("fp").agg(F.min(keep).alias("least")))
    joined = components(links(nodes.select("fp"), radius, groups, dense))
    rooted = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # cut, so that both sides of the join are dealt anew and a large class can be split
    label = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = rooted.join(label, "root").select("fp", "component_id")
    code = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(classes, "fp").select(named(keep), "fp", code.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each class, the one with the least doc_id, with all its columns.

    Rows without an id cannot be named by a class and stay.  Of rows that repeat
    an id one stays.
    """
    found = near_duplicates(docs.where(F.col("doc_id").isNotNull()), text)
    first = cut(found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct())
    kept = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*[named(c) for c in docs.columns]).union(docs.where(F.col("doc_id").isNull()))
