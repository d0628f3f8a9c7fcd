"""Shared pieces: Arrow batch plumbing, vectorised word scanning and hashing.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which is what
``bytes.split()`` yields.  Hashes are polynomials modulo 2**64 over random byte
codes, so the hash of any word range is a difference of prefix sums.  A hash only
proposes that things are equal: whoever uses it compares words or bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step works on (its temporaries are some 60 times that).
STEP_BYTES = 1 << 20

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15 | 1
_R2 = 0xD1342543DE82EF95 | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to a step's size they are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, STEP_BYTES + 1024), np.uint64(base), np.uint64)
        a[0] = 1
        have = np.cumprod(a, dtype=np.uint64)
        if len(have) <= STEP_BYTES + 1024:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of mixed values behave like random ones."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def range_sum(prefix: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum over [start, end) of code * base**(place in the range), from prefix sums of code * base**i."""
    return (prefix[end] - prefix[start]) * powers(inverse(base), len(prefix))[start]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ascending disjoint byte ranges, some STEP_BYTES at a time."""
    out = np.zeros(len(start), np.uint64)
    k = 0
    while k < len(start):
        base = int(start[k])
        last = max(k + 1, int(np.searchsorted(end, base + STEP_BYTES, "right")))
        if int(end[last - 1]) - base > STEP_BYTES:  # one long range: the sum of its parts
            total = 0
            for at in range(base, int(end[k]), STEP_BYTES):
                part = data[at : min(at + STEP_BYTES, int(end[k]))]
                total += int((_CODES[part] * powers(_R, len(part))).sum(dtype=np.uint64)) * pow(_R, at - base, 1 << 64)
            out[k] = total % (1 << 64)
        else:
            part = data[base : int(end[last - 1])]
            prefix = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_CODES[part] * powers(_R, len(part)), out=prefix[1:])
            out[k:last] = range_sum(prefix, _R, start[k:last] - base, end[k:last] - base)
        k = last
    return mix(out)


def same_ranges(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the bytes of [a, a_end) are those of [b, b_end), some STEP_BYTES at a time."""
    size = a_end - a
    out = size == b_end - b
    check = np.flatnonzero(out & (size > 0))
    sums = np.cumsum(size[check])
    k = 0
    while k < len(check):
        done = int(sums[k - 1]) if k else 0
        last = max(k + 1, int(np.searchsorted(sums, done + STEP_BYTES, "right")))
        some = check[k:last]
        if len(some) == 1:
            i = some[0]
            out[i] = np.array_equal(data[a[i] : a_end[i]], data[b[i] : b_end[i]])
        else:
            n = size[some]
            first = np.cumsum(n) - n
            inner = np.arange(int(n.sum())) - np.repeat(first, n)
            differ = data[np.repeat(a[some], n) + inner] != data[np.repeat(b[some], n) + inner]
            out[some] = ~np.logical_or.reduceat(differ, first)
        k = last
    return out


class Words:
    """The words of several texts: byte spans, owner and hash of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: the bytes of all texts; offsets: len(texts) + 1 bounds, from 0."""
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        n = len(data)
        inside = ~_SEP[data]
        starts, ends = inside.copy(), inside.copy()
        if n:
            edge = np.zeros(n + 1, bool)
            edge[offsets] = True
            starts[1:] &= ~inside[:-1] | edge[1:-1]
            ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.inside = inside
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        #: words of document k are word_offsets[k] to word_offsets[k + 1]
        self.word_offsets = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.word_offsets)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        self.hash = range_hashes(data, self.start, self.end)
        self._word_prefix = self._number = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def number(self) -> np.ndarray:
        """A number for each word: the same for equal words, and only for those."""
        if self._number is None:
            _, first, number = np.unique(self.hash, return_index=True, return_inverse=True)
            head = first[number]
            if not same_ranges(self.data, self.start, self.end, self.start[head], self.end[head]).all():
                raw, known = self.data.tobytes(), {}
                number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(self.start.tolist(), self.end.tolist())], np.int64)
            self._number = number
        return self._number

    def span_hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the words [first, last)."""
        if self._word_prefix is None:
            self._word_prefix = np.zeros(len(self) + 1, np.uint64)
            np.cumsum(self.hash * powers(_R2, len(self)), out=self._word_prefix[1:])
        return mix(range_sum(self._word_prefix, _R2, first, last))

    def window_numbers(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of k words of one document, and a number for each: the same for equal windows only."""
        i = np.arange(max(0, len(self) - k + 1))
        i = i[self.doc[i] == self.doc[i + k - 1]] if len(i) else i
        if not len(i):
            return i, i
        key = self.span_hash(i, i + k)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        a, b = i[order][1:][same], i[order][:-1][same]
        if all((self.number[a + j] == self.number[b + j]).all() for j in range(k)):
            number = np.empty(len(i), np.int64)
            number[order] = np.append(0, np.cumsum(~same))
            return i, number
        # a hash met two windows: number them word by word
        number = self.number[i]
        for j in range(1, k):
            _, number = np.unique(number * (int(self.number.max()) + 1) + self.number[i + j], return_inverse=True)
        return i, number

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array of flags over each text."""
        if self.n_docs == 1:
            return np.array([np.count_nonzero(flags)], np.int64)
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def covered(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which words lie in one of the word ranges [first, last)."""
        change = np.zeros(len(self) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, last, -1)
        return np.cumsum(change[:-1]) > 0

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """Each text's kept words, one space between."""
        kept = np.flatnonzero(keep)
        last = np.ones(len(kept), bool)
        last[:-1] = self.doc[kept[1:]] != self.doc[kept[:-1]]
        change = np.zeros(len(self.data) + 1, np.int8)
        change[self.start[kept]] += 1
        change[self.end[kept]] -= 1
        out = np.cumsum(change[:-1], dtype=np.int8) > 0
        # the separator after a word that another kept one follows becomes the space
        space = self.end[kept[~last]]
        out[space] = True
        raw = self.data.copy()
        raw[space] = 0x20
        ends = np.append(0, np.cumsum(self.per_doc(out)))
        whole = raw[out].tobytes()
        return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def words(self, k: int) -> list[bytes]:
        """The words of text k."""
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes().split()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and the bounds of each; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, bounds


def text_steps(column: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of some ``size`` bytes; a null is an empty text.

    A longer text is a run of its own and never split.
    """
    data, bounds = text_buffer(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def word_steps(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for first, last, data, offsets in text_steps(column):
        yield first, last, Words(data, offsets)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function from a batch to dicts of columns."""
    arrow = schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in fn(batch):
                    yield pa.record_batch([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def schema_of(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def named(column: str) -> "F.Column":
    """A column by its name, whatever characters that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(names: list[str], wish: str) -> str:
    """A column name that none of the names equals in any case."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish += "_"
    return wish


def held_out(doc_id) -> "F.Column":
    """True where crc32 of the id as text leaves 1 modulo 3: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names, or the one set on the context.

    Where neither is set, a local session gets a folder of its own; a cluster has to name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context._jsc.sc().getCheckpointDir().get()
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        import tempfile

        folder = tempfile.mkdtemp(prefix="plinth-checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that lost executors cost one read."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
