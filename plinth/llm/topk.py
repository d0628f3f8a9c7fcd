"""Exact top-k inner products with norm order and rotated residual bounds.

Components become integers floor(scale * x).  Candidates are dealt to groups by
descending length, each of a bounded number of components; within a group they are
processed by descending length.  All vectors are projected on the leading right
singular vectors of a bounded sample, which carry most of a product; what is left is
bounded by the product of the residual lengths (Cauchy-Schwarz).  A query goes only
to groups whose longest vector can reach its threshold, and is done with a group
once its k-th best score exceeds its length times the longest length to come.
Survivors are scored exactly in integers, so the projection never decides a result.

Queries form blocks by how many groups they have to visit, and a group is sent to
the blocks that visit it.  Vectors of one length are spread over the groups of that
length by a hash.

Null vectors and vectors with null or non-finite components take no part.
Vectors of different lengths meet in their common components, and are grouped by
the power of two of their number of components, so that one long vector does not
widen the others.  Equal vectors are separate candidates, ties go to the smaller id;
a row without an id takes no part.  With fewer than k candidates all are returned.
Products are exact while dimension times the squared largest component stays below
2**62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix

SCALE = 1024
K = 10
#: Components of a candidate group and of a query block, and rows of either at most.
COMPONENTS, GROUP_MOST, BLOCK = 1 << 23, 65_536, 16_384
#: Queries scored at a time, and boundaries of groups that are told apart by length; more groups share them by a hash.
QUERIES, BOUNDS = 512, 1024
#: Longest vectors that give every query its first threshold, and sample for the projection; components of either at most.
LONGEST, SAMPLE, DRIVER_COMPONENTS = 2048, 4096, 1 << 22
#: Projected components in the partial sums, and vectors processed at a time.
LEADING, STEP = 16, 1024

RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<long>) and its squared length, for the vectors that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))
    rows = rows.withColumn("width", F.length(F.bin(F.size("v"))))  # up to a power of two
    return rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of integers, filled up with zeros to the longest."""
    column = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    dim = max(1, int(sizes.max(initial=0)))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products over the common components; by floating point where that is exact."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def projected(v: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, leading components and residual length of each row; missing components are zeros."""
    dim = min(v.shape[1], len(axes))
    length = np.linalg.norm(v.astype(float), axis=1)
    turned = v[:, :dim] @ axes[:dim]
    rest = np.sqrt(np.maximum(length**2 - (turned**2).sum(1), 0)) + 1e-7 * length
    return length, turned, rest


def leading_axes(sample: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of a sample, as columns."""
    return np.linalg.svd(sample.astype(float), full_matrices=False)[2][:LEADING].T if len(sample) else np.zeros((1, 1))


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Candidates:
    """A candidate group, longest first, with its projected vectors."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, axes: np.ndarray):
        order = np.argsort(-np.linalg.norm(v.astype(float), axis=1), kind="stable")
        self.ids, self.v, self.axes = ids[order], v[order], axes
        self.length, self.turned, self.rest = projected(self.v, axes)


def search(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, group: Candidates, k: int = K, step: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best of the group with a score of at least its floor."""
    length_q, turned_q, rest_q = projected(q, group.axes)
    length_c, c_ids, c = group.length, group.ids, group.v
    need = floor.astype(np.float64)  # a lower bound of the k-th best score
    found_ids = [np.zeros(0, np.int64)] * len(q)
    found = [np.zeros(0, np.int64)] * len(q)
    slack = 1e-9
    for at in range(0, len(c), step):
        part = np.arange(at, min(at + step, len(c)))
        reach = length_q * length_c[at]
        live = np.flatnonzero(reach * (1 + slack) + 1 >= need)
        if not len(live):
            break
        bound = turned_q[live] @ group.turned[part].T + rest_q[live, None] * group.rest[part][None, :]
        bound += slack * (reach[live, None] + 1) + 1e-6
        keep = (bound >= need[live, None]) & (q_ids[live, None] != c_ids[part][None, :])
        for row, i in enumerate(live):
            some = part[keep[row]]
            if len(some):
                scores = exact_products(q[i : i + 1], c[some])[0]
                good = scores >= need[i]
                ids, scores = np.append(found_ids[i], c_ids[some[good]]), np.append(found[i], scores[good])
                found_ids[i], found[i] = best_of(ids, scores, k)
                if len(found[i]) == k:
                    need[i] = max(need[i], float(found[i][-1]))
    for i in range(len(q)):
        if len(found[i]):
            yield int(q_ids[i]), found_ids[i], found[i]


def _table(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    ids = np.concatenate([np.full(len(s), i, np.int64) for i, _, s in rows]) if rows else np.zeros(0, np.int64)
    join = lambda k: np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64)
    return pa.table({"query_id": ids, "vec_id": join(1), "score": join(2)})


def _dealt(sizes: list[int], most: int, wide: int) -> int:
    """Groups for so many rows of at most ``wide`` components."""
    return max(1, -(-sum(sizes) // max(1, min(most, COMPONENTS // max(1, wide)))))


class Groups:
    """How candidates are dealt: by width, then by length, descending.

    Each width has boundaries of squared length.  Vectors of exactly a boundary's
    length go to any of the groups that it parts, by a hash.
    """

    def __init__(self, widths: list[tuple[int, int, list[float], float]], group: int | None):
        #: of each width: its first group, the descending boundaries, groups that share a place between two
        self.first: dict[int, tuple[int, np.ndarray, int]] = {}
        self.longest: list[float] = []  # length of each group's longest vector, at most
        for width, n, quantiles, top in widths:
            count = -(-n // group) if group else _dealt([n], GROUP_MOST, 1 << width)
            places = min(count, BOUNDS)
            share = -(-count // places)
            bounds = np.array([quantiles[round(len(quantiles) * (1 - k / places)) - 1] for k in range(1, places)])
            self.first[width] = (len(self.longest), bounds, share)
            for edge in np.sqrt([top, *bounds]).tolist():
                self.longest += [edge] * share

    def __len__(self) -> int:
        return len(self.longest)

    def of(self, width: np.ndarray, norm: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(width), np.int64)
        even = mix(ids.astype(np.uint64))
        for w in np.unique(width).tolist():
            first, bounds, share = self.first[w]
            here = width == w
            low = np.searchsorted(-bounds, -norm[here], "left")
            high = np.searchsorted(-bounds, -norm[here], "right")
            place = low + (even[here] % (high - low + 1).astype(np.uint64)).astype(np.int64)
            out[here] = first + place * share + (even[here] >> np.uint64(32)).astype(np.int64) % share
        return out


def top_k(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, k: int = K, group: int | None = None, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` where is_query holds (a condition on vec_id)."""
    rows = cut(quantised(vectors, key, vector, scale))
    steps = [(j + 1) / BOUNDS for j in range(BOUNDS)]
    sums = rows.groupBy("width").agg(F.count("*").alias("n"), F.percentile_approx("norm", steps, 100_000).alias("q"), F.max("norm").alias("top"), F.count_if(is_query).alias("asked")).collect()  # some 30 widths at most
    sums.sort(key=lambda r: r.width)
    groups = Groups([(r.width, r.n, r.q, r.top) for r in sums], group)
    # both are bounded, whatever the table's size and the vectors' lengths
    wide = 1 << max([r.width for r in sums], default=0)
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(LEADING, min(SAMPLE, DRIVER_COMPONENTS // wide))).select("v").toArrow().column("v"))
    head = rows.orderBy(F.desc("norm"), "vec_id").limit(max(k + 1, min(LONGEST, DRIVER_COMPONENTS // wide))).select("vec_id", "v").toArrow()
    head_ids, head_v = head.column("vec_id").to_numpy(), matrix(head.column("v"))
    axes = leading_axes(sample)
    longest = np.array(groups.longest)
    low = -(2**62)

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            floor = np.full(len(ids), low, np.int64)
            q = matrix(b.column("v"))
            for at in range(0, len(ids), QUERIES):
                scores = exact_products(q[at : at + QUERIES], head_v)
                for i, row in enumerate(scores):
                    row = row[head_ids != ids[at + i]]
                    if len(row) >= k:
                        floor[at + i] = np.partition(row, len(row) - k)[len(row) - k]
            reach = np.linalg.norm(q.astype(float), axis=1)[:, None] * longest[None, :] * (1 + 1e-9) + 1 >= floor[:, None]
            visits = [np.flatnonzero(r).astype(np.int32) for r in reach]
            yield pa.record_batch({"vec_id": b.column("vec_id"), "v": b.column("v"), "floor": pa.array(floor), "visits": pa.array(visits, pa.list_(pa.int32()))})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = groups.of(b.column("width").to_numpy(), b.column("norm").to_numpy(), b.column("vec_id").to_numpy())
            yield pa.record_batch({"vec_id": b.column("vec_id"), "v": b.column("v"), "part": pa.array(part.astype(np.int32))})

    first = cut(rows.where(is_query).select("vec_id", "v").mapInArrow(thresholds, "vec_id long, v array<long>, floor long, visits array<int>"))
    n_blocks = -(-sum(r.asked for r in sums) // block) if block else _dealt([r.asked for r in sums], BLOCK, wide)
    # queries that visit about as many groups share blocks; which blocks visit a group is a table of pairs of numbers
    share = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, n_blocks))).cast("int")
    sized = first.withColumn("many", F.length(F.bin(F.size("visits")))).withColumn("block", F.concat_ws("-", "many", share))
    left = sized.select("vec_id", "v", "floor", "block", F.explode("visits").alias("part"))
    pairs = cut(left.select("block", "part").distinct())
    right = rows.select("vec_id", "v", "width", "norm").mapInArrow(placed, "vec_id long, v array<long>, part int").join(pairs, "part")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _table([])
        q, q_ids, floor = matrix(a.column("v")), a.column("vec_id").to_numpy(), a.column("floor").to_numpy()
        candidates = Candidates(b.column("vec_id").to_numpy(), matrix(b.column("v")), axes)
        parts = (slice(at, at + QUERIES) for at in range(0, len(q), QUERIES))
        return _table([row for p in parts for row in search(q_ids[p], q[p], floor[p], candidates, k)])

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
