"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against the texts before it: a factor is a run of words
that an earlier text (or an earlier place of its own) holds too, extended word by
word as far as both agree, and a factor of at least WINDOW words is duplicate.

Index.  Anchors index the reference.  The anchor of a window of WINDOW words is its
least hashed phrase of PHRASE words, so equal windows have equal anchors at equal
places, whatever stands around them.  Successive windows with one anchor make a
tile.  Equal tiles are found by grouping, and where tiles of an anchor differ, so
are the equal windows among theirs.  This gives each window that may be duplicate
one earlier place, and no pair is ever formed.

Parse.  A batch of rows is a reference block of its own: tiles that repeat earlier
words of the batch are compared with them there and then and joined to factors.  All
others ask for the words at their earlier place.  What is asked of a text is cut
out of it once, in blocks of CELL windows, and the document is parsed against the
blocks that it asked for: aligned at its places, extended over all equal words,
the longest factor first, and at each factor's end the windows that reach across.

Hashes only propose; a factor's words were compared.  Where words differ under one
hash, the windows of that anchor are grouped by their words (``_exact``).

Null texts have no words.  Texts shorter than WINDOW lose nothing.  Rows with one
doc_id are not earlier than each other, equal or not: a repeated row keeps its words
and distinct texts under one id are factored each for itself.  A row without an id
comes before all others.  Only doc_id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, cut, map_batches, mix, named, text_buffer, text_steps

WINDOW = 20
PHRASE = 6
#: Windows of a block that is cut out of the reference, and bytes of the rows that are one for each other.
CELL, BLOCK_BYTES = 256, 12 << 20
_SALT = np.uint64(0x5851F42D4C957F2D)
#: Sort keys need an order on ids; a row without one comes first.
_NO_ID = np.iinfo(np.int64).min
#: What is known of a span: an earlier place was compared, one is proposed, one is in doubt.
KNOWN, PROPOSED, DOUBT = 0, 1, 2


def _tiles(words: Words) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor hash and span hash of each tile."""
    none = np.zeros(0, np.int64)
    span = WINDOW - PHRASE + 1
    count = len(words) - WINDOW + 1
    if count <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(len(words) - PHRASE + 1)
    phrase = words.span_hash(at, at + PHRASE)
    # leftmost least phrase of each run of ``span`` phrases, by doubling
    best, width = at.copy(), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(phrase[right] < phrase[left], right, left)
        width += step
    best = best[:count]
    first = np.flatnonzero(words.doc[:count] == words.doc[WINDOW - 1 :])
    if not len(first):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = best[first]
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(first) > 1)
    start = first[new]
    n = np.diff(np.append(np.flatnonzero(new), len(first)))
    a = anchor[new]
    span_hash = words.span_hash(start, start + n + WINDOW - 1) ^ mix((a - start).astype(np.uint64) + _SALT)
    return start, n, phrase[a], span_hash


# ------------------------------------------------------------------ spans of a batch

SPAN = "doc long, tag int, start int, n int, anchor long, span long, known boolean"


class _Spans:
    """Spans of windows of a batch, in the order of rows and places."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, words: Words, first_row: int, first_byte: int, at: np.ndarray, n: np.ndarray, anchor: np.ndarray, span: np.ndarray) -> None:
        """at: first words, counted over the step."""
        if len(at):
            owner = words.doc[at]
            self.parts.append((first_row + owner, at - words.word_offsets[owner], n, anchor, span, first_byte + words.start[at], first_byte + words.end[at + n + WINDOW - 2]))

    def settled(self, doc: np.ndarray, tag: np.ndarray, raw: bytes) -> dict:
        """SPAN columns: factors against the batch itself, joined, and all other spans as they are."""
        if not self.parts:
            none = np.zeros(0, np.int64)
            return dict(zip(("doc", "tag", "start", "n", "anchor", "span", "known"), [none] * 6 + [none.astype(bool)]))
        row, start, n, anchor, span, a, b = (np.concatenate(p) for p in zip(*self.parts))
        source = self._sources(doc[row], row, start, anchor, span)
        known = source >= 0
        to = np.maximum(source, 0)
        # successive spans whose sources are successive are one factor
        new = np.ones(len(row), bool)
        if len(row) > 1:
            shift = start[to] - start
            new[1:] = ~known[1:] | ~known[:-1] | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (row[to][1:] != row[to][:-1]) | (shift[1:] != shift[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(row)) - 1
        factor = known[head]
        same = lambda i, j: raw[a[i] : b[j]] == raw[a[to[i]] : b[to[j]]] or raw[a[i] : b[j]].split() == raw[a[to[i]] : b[to[j]]].split()
        bad = [k for k in np.flatnonzero(factor).tolist() if not same(head[k], tail[k])]
        if bad:  # a hash met other words: each span of such a factor for itself
            for k in bad:
                for i in range(head[k], tail[k] + 1):
                    known[i] = same(i, i)
                    new[i] = True
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(row)) - 1
            factor = known[head]
        return {
            "doc": doc[row[head]], "tag": tag[row[head]], "start": start[head], "n": start[tail] + n[tail] - start[head],
            "anchor": anchor[head].view(np.int64), "span": span[head].view(np.int64), "known": factor,
        }

    @staticmethod
    def _sources(doc: np.ndarray, row: np.ndarray, start: np.ndarray, anchor: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Of each span an equal one of a smaller id, or else the first of its own row, or -1."""
        order = np.lexsort((start, row, doc, anchor, span))
        i = np.arange(len(order))
        s, d, r = span[order], doc[order], row[order]
        new = np.ones(len(order), bool)
        new[1:] = (s[1:] != s[:-1]) | (anchor[order][1:] != anchor[order][:-1])
        head = np.maximum.accumulate(np.where(new, i, 0))
        mine = new.copy()
        mine[1:] |= r[1:] != r[:-1]
        own = np.maximum.accumulate(np.where(mine, i, 0))
        found = np.where(d > d[head], head, np.where(own < i, own, -1))
        out = np.full(len(order), -1, np.int64)
        out[order] = np.where(found >= 0, order[np.maximum(found, 0)], -1)
        return out


@dataclass
class _Block:
    """Rows of a batch that are a reference block of their own."""

    first: int
    texts: pa.Array
    key: np.ndarray
    tag: np.ndarray
    bounds: np.ndarray
    raw: bytes


def _blocks(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[_Block]:
    key, tag = _column(batch, "key"), _column(batch, "tag")
    for first, last, data, bounds in text_steps(texts, BLOCK_BYTES):
        yield _Block(first, texts[first:last], key[first:last], tag[first:last], bounds, data.tobytes())


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(spans: DataFrame) -> DataFrame:
    """Known spans, whose outcome is settled, are dealt evenly: one pass serves both kinds."""
    even = lambda c, k: F.when(F.col("known"), F.xxhash64("doc", "start", F.lit(k))).otherwise(F.col(c)).alias(c)
    return spans.select("doc", "tag", "start", "n", "known", even("anchor", 0), even("span", 1))


def _marks(spans: DataFrame, doubts: bool) -> DataFrame:
    """doc, tag, start, n, kind, and the proposed earlier place: sdoc, stag, sstart."""
    first = F.min(F.struct("doc", "tag", "start")).over(Window.partitionBy("known", "anchor", "span"))
    rows = _spread(spans).withColumn("first", first)
    proposed = F.when(F.col("known"), F.lit(KNOWN)).when(F.col("first.doc") < F.col("doc"), F.lit(PROPOSED))
    if doubts:
        by_anchor = Window.partitionBy("known", "anchor")
        rows = rows.withColumn("lo", F.min("span").over(by_anchor)).withColumn("hi", F.max("span").over(by_anchor))
        proposed = proposed.when(F.col("lo") < F.col("hi"), F.lit(DOUBT))
    rows = rows.withColumn("kind", proposed).where("kind is not null")
    place = lambda c: F.when(F.col("kind") == PROPOSED, F.col(f"first.{c}")).alias(f"s{c}")
    return rows.select("doc", "tag", "start", "n", "kind", *[place(c) for c in ("doc", "tag", "start")])


def _by_text(marks: DataFrame, name: str) -> DataFrame:
    """key, tag and a text's marks: no more of them than the text has windows."""
    return marks.groupBy(F.col("doc").alias("key"), "tag").agg(F.collect_list(F.struct("start", "n", "kind", "sdoc", "stag", "sstart")).alias(name))


class _Lists:
    """A column of lists of structs as flat arrays with bounds."""

    def __init__(self, column: pa.Array):
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds = np.append(0, np.cumsum(sizes))
        flat = column.flatten()
        self.fields = {f.name: pc.fill_null(pc.struct_field(flat, [i]), 0) if pa.types.is_integer(f.type) else pc.struct_field(flat, [i]) for i, f in enumerate(flat.type)}
        self.row = np.repeat(np.arange(len(sizes)), sizes)

    def __getitem__(self, name: str) -> np.ndarray:
        if isinstance(self.fields[name], (pa.Array, pa.ChunkedArray)):
            self.fields[name] = self.fields[name].to_numpy(zero_copy_only=False).astype(np.int64)
        return self.fields[name]

    def within(self, first: int, last: int) -> slice:
        """The elements of the rows [first, last)."""
        return slice(self.bounds[first], self.bounds[last])


# ------------------------------------------------------------------ passes over texts

def _rows(docs: DataFrame, text: str, rest: list[str]) -> DataFrame:
    """doc_id, key (an id that can be ordered), tag (tells texts of one id apart), text and the other columns in one."""
    tag = F.pmod(F.xxhash64(named(text)), F.lit(1 << 31)).cast("int")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), tag.alias("tag"), named(text).alias("text"), F.struct(F.lit(0).alias("none"), *[named(c) for c in rest]).alias("rest"))


def _dealt(rows: DataFrame) -> DataFrame:
    """The texts, compressed, dealt by key and tag."""
    import zstandard
    from pyspark.sql.types import BinaryType, StructField, StructType

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        pack = zstandard.ZstdCompressor(level=1).compress
        data, bounds = text_buffer(batch.column("text"))
        null = pc.is_null(batch.column("text")).to_pylist()
        packed = [None if no else pack(data[a:b].tobytes()) for no, a, b in zip(null, bounds[:-1].tolist(), bounds[1:].tolist())]
        yield {"z": packed} | {c: batch.column(c) for c in ("doc_id", "key", "tag", "rest")}

    schema = StructType([*(rows.schema[c] for c in ("doc_id", "key", "tag")), StructField("z", BinaryType()), rows.schema["rest"]])
    return map_batches(rows, run, schema).repartition("key", "tag")


def _unpacked(column: pa.Array) -> pa.Array:
    """Texts of a column of _dealt."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([None if z is None else unpack(z) for z in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


def tiles(rows: DataFrame) -> DataFrame:
    """SPAN rows: the tiles of every text."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in _blocks(batch, batch.column("text")):
            spans = _Spans()
            for first, _, data, offsets in text_steps(part.texts):
                words = Words(data, offsets)
                spans.add(words, first, int(part.bounds[first]), *_tiles(words))
            yield spans.settled(part.key, part.tag, part.raw)

    return map_batches(rows.select("key", "tag", "text"), run, SPAN)


def windows(dealt: DataFrame, marks: DataFrame) -> DataFrame:
    """SPAN rows: the windows of the tiles in doubt, two hashes of each in place of anchor and span."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        lists, half = _Lists(batch.column("marks")), WINDOW // 2
        for part in _blocks(batch, _unpacked(batch.column("z"))):
            spans = _Spans()
            for first, last, data, offsets in text_steps(part.texts):
                words, some = Words(data, offsets), lists.within(part.first + first, part.first + last)
                doubt = lists["kind"][some] == DOUBT
                at, owner = _starts(lists["start"][some][doubt], lists["n"][some][doubt], lists.row[some][doubt] - part.first - first)
                at = at + words.word_offsets[owner]
                ok = at + WINDOW <= words.word_offsets[owner + 1]  # false only for other texts with the same key and tag
                at = np.unique(at[ok])
                spans.add(words, first, int(part.bounds[first]), at, np.ones(len(at), np.int64), words.span_hash(at, at + WINDOW), words.span_hash(at, at + half) + _SALT * words.span_hash(at + half, at + WINDOW))
            yield spans.settled(part.key, part.tag, part.raw)

    asked = marks.where(F.exists("marks", lambda m: m["kind"] == DOUBT))
    return map_batches(dealt.join(asked, ["key", "tag"]).select("key", "tag", "z", "marks"), run, SPAN)


def _starts(start: np.ndarray, n: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of spans, one by one, with their owners."""
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(start, n) + inner, np.repeat(owner, n)


ASKED = "key long, tag int, start int, n int, sdoc long, stag int, cell int, at int"


def asked(marks: DataFrame, name: str) -> DataFrame:
    """ASKED rows: successive proposals joined, and cut where a reference block ends."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        lists = _Lists(batch.column(name))
        some = np.flatnonzero(lists["kind"] == PROPOSED)
        row, start, n, sdoc, stag, sstart = (x[some] for x in (lists.row, *(lists[c] for c in ("start", "n", "sdoc", "stag", "sstart"))))
        shift = sstart - start
        order = np.lexsort((start, shift, stag, sdoc, row))
        row, start, n, sdoc, stag, shift = (x[order] for x in (row, start, n, sdoc, stag, shift))
        new = np.ones(len(row), bool)
        if len(row) > 1:
            new[1:] = (row[1:] != row[:-1]) | (sdoc[1:] != sdoc[:-1]) | (stag[1:] != stag[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > start[:-1] + n[:-1])
        head = np.flatnonzero(new)
        end = np.maximum.reduceat(start + n, head) if len(head) else head
        row, start, sdoc, stag, shift = (x[head] for x in (row, start, sdoc, stag, shift))
        low, high = (start + shift) // CELL, (end + shift - 1) // CELL
        cell, owner = _starts(low, high - low + 1, np.arange(len(row)))
        at = np.maximum((start + shift)[owner], cell * CELL)
        stop = np.minimum((end + shift)[owner], (cell + 1) * CELL)
        yield {
            "key": _column(batch, "key")[row[owner]], "tag": _column(batch, "tag")[row[owner]], "start": at - shift[owner], "n": stop - at,
            "sdoc": sdoc[owner], "stag": stag[owner], "cell": cell, "at": at,
        }

    return map_batches(marks.where(F.exists(name, lambda m: m["kind"] == PROPOSED)).select("key", "tag", name), run, ASKED)


def blocks(dealt: DataFrame, wanted: DataFrame) -> DataFrame:
    """sdoc, stag, cell, lo, words: what is asked of the reference, cut out of its texts once."""
    parts = wanted.groupBy("sdoc", "stag", "cell").agg(F.min("at").alias("lo"), F.max(F.col("at") + F.col("n")).alias("hi"))
    lists = parts.groupBy(F.col("sdoc").alias("key"), F.col("stag").alias("tag")).agg(F.collect_list(F.struct("cell", "lo", "hi")).alias("parts"))  # no more than the text has blocks

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        lists, texts = _Lists(batch.column("parts")), batch.column("z")
        key, tag = _column(batch, "key"), _column(batch, "tag")
        cell, lo, hi = lists["cell"], lists["lo"], lists["hi"]
        for k in range(batch.num_rows):
            some = lists.within(k, k + 1)
            words = Words(*text_buffer(_unpacked(texts[k : k + 1])))
            raw, out = words.data.tobytes(), []
            for a, b in zip(lo[some].tolist(), hi[some].tolist()):
                b = min(b + WINDOW - 1, len(words))  # less only for another text with the same key and tag
                out.append(b" ".join(raw[words.start[a] : words.end[b - 1]].split()).decode() if a < b else "")
            n = len(out)
            yield {"sdoc": np.full(n, key[k]), "stag": np.full(n, tag[k]), "cell": cell[some], "lo": lo[some], "words": out}

    return map_batches(dealt.join(lists, ["key", "tag"]).select("key", "tag", "z", "parts"), run, "sdoc long, stag int, cell int, lo int, words string")


def pieces(dealt: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, tag and the pieces of the reference that a text is parsed against: its own start, and the words there."""
    met = wanted.join(blocks(dealt, wanted), ["sdoc", "stag", "cell"])
    part = F.array_join(F.slice(F.split("words", " "), F.col("at") - F.col("lo") + 1, F.col("n") + (WINDOW - 1)), " ")
    return met.select("key", "tag", "start", part.alias("words")).groupBy("key", "tag").agg(F.collect_list(F.struct("start", "words")).alias("pieces"))


# ------------------------------------------------------------------ the parse

def equal_runs(own: list[bytes], start: int, ref: list[bytes]) -> list[tuple[int, int]]:
    """The runs of at least WINDOW words that a text and a piece aligned at ``start`` share, each as long as both agree."""
    n = min(len(ref), len(own) - start)
    if n >= WINDOW and own[start : start + n] == ref[:n]:
        return [(start, start + n)]
    out, begin = [], None
    for j in range(n + 1):
        if j < n and own[start + j] == ref[j]:
            begin = j if begin is None else begin
        elif begin is not None:
            if j - begin >= WINDOW:
                out.append((start + begin, start + j))
            begin = None
    return out


def parse(own: list[bytes], against: list[tuple[int, list[bytes]]]) -> list[tuple[int, int]]:
    """Greedy factors (first, last) of a text: from left to right the longest that starts by the last one's boundary windows.

    The next factor may start WINDOW - 1 words before the end of the one before, so a
    window across the boundary is not lost.
    """
    runs = sorted(r for start, ref in against for r in equal_runs(own, start, ref))
    out, reach, k = [], 0, 0
    while k < len(runs):
        # of the runs that start no later than the next window may, the longest
        limit, best = max(reach - WINDOW + 1, runs[k][0]), runs[k]
        while k < len(runs) and runs[k][0] <= limit:
            best = max(best, runs[k], key=lambda r: r[1])
            k += 1
        if best[1] > reach:
            out.append(best)
            reach = best[1]
    return out


_LIST = "array<struct<start:int,n:int,kind:int,sdoc:bigint,stag:int,sstart:int>>"


def _parsed(dealt: DataFrame, lists: list[DataFrame], found: DataFrame, want_text: str) -> DataFrame:
    """RESULT of every text, and the anchors of proposals that the words did not bear out.

    lists: marks, windows in doubt, and exact ones.  want_text: all, changed or none.
    """
    from pyspark.sql.types import StructType

    names = ["marks", "more", "exact"]
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, z binary, spans array<struct<first:int,last:int>>, refuted array<long>")
    schema = StructType(schema.fields + [dealt.schema["rest"]])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        texts, marks, refs = _unpacked(batch.column("z")), [_Lists(batch.column(c)) for c in names], _Lists(batch.column("pieces"))
        ref_words = refs.fields["words"]
        for first, last, part, offsets in text_steps(texts):
            words = Words(part, offsets)
            gone = np.zeros(len(words), bool)
            proposed = np.zeros(len(words), bool)  # windows
            borne = np.zeros(len(words), bool)
            for m in marks:
                some = m.within(first, last)
                owner, kind = m.row[some] - first, m["kind"][some]
                at = words.word_offsets[owner] + m["start"][some]
                end = at + m["n"][some]
                fits = end + WINDOW - 1 <= words.word_offsets[owner + 1]  # not only for other texts with the same key and tag
                known, open_ = fits & (kind == KNOWN), fits & (kind == PROPOSED)
                gone |= words.covered(at[known], end[known] + WINDOW - 1)
                borne |= words.covered(at[known], end[known])
                proposed |= words.covered(at[open_], end[open_])
            for k in range(first, last):
                some = refs.within(k, k + 1)
                if some.start < some.stop:
                    base = words.word_offsets[k - first]
                    for a, b in parse(words.words(k - first), [(s, w.split()) for s, w in zip(refs["start"][some].tolist(), ref_words[some].cast(pa.binary()).to_pylist())]):
                        gone[base + a : base + b] = True
                        borne[base + a : base + b - WINDOW + 1] = True
            removed = np.bincount(words.doc[gone], minlength=last - first)
            kept = words.joined(~gone)
            refuted = np.flatnonzero(proposed & ~borne)
            yield {
                "doc_id": batch.column("doc_id")[first:last], "n_words": words.counts, "n_removed": removed,
                "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
                "z": [pack(k) if want_text == "all" or want_text == "changed" and r else z for k, r, z in zip(kept, removed.tolist(), batch.column("z")[first:last].to_pylist() if want_text == "changed" else [None] * len(kept))],
                "spans": _runs(words, gone), "refuted": _anchors(words, refuted), "rest": batch.column("rest")[first:last],
            }

    joined = dealt
    for name, rows in zip(names, lists):
        joined = joined.join(rows, ["key", "tag"], "left") if rows is not None else joined.withColumn(name, F.lit(None).cast(_LIST))
    joined = joined.join(found, ["key", "tag"], "left")
    return map_batches(joined.select("doc_id", "z", "rest", *names, "pieces"), run, schema)


def _runs(words: Words, gone: np.ndarray) -> list[list[dict]]:
    """The removed word ranges of each text."""
    out = []
    for k in range(words.n_docs):
        dead = gone[words.word_offsets[k] : words.word_offsets[k + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], dead.astype(np.int8), [0])))) if dead.any() else []
        out.append([{"first": a, "last": b} for a, b in zip(edge[::2], edge[1::2])])
    return out


def _anchors(words: Words, refuted: np.ndarray) -> list[list[int]]:
    """Per text the anchors of some of its windows."""
    out: list[list[int]] = [[] for _ in range(words.n_docs)]
    if len(refuted):
        start, _, anchor, _ = _tiles(words)
        tile = np.searchsorted(start, refuted, "right") - 1
        for k, a in set(zip(words.doc[refuted].tolist(), anchor[tile].view(np.int64).tolist())):
            out[k].append(a)
    return out


def _exact(rows: DataFrame, dealt: DataFrame, anchors: DataFrame) -> DataFrame:
    """Marks of the windows of some anchors, by grouping their words."""

    def cut_out(batch: pa.RecordBatch) -> Iterator[dict]:
        texts, lists = _unpacked(batch.column("z")), _Lists(batch.column("marks"))
        key, tag = _column(batch, "key"), _column(batch, "tag")
        for first, last, part, offsets in text_steps(texts):
            words, some = Words(part, offsets), lists.within(first, last)
            at, owner = _starts(lists["start"][some], lists["n"][some], lists.row[some] - first)
            raw, a = words.data.tobytes(), at + words.word_offsets[owner]
            held = [b" ".join(raw[x:y].split()).decode() for x, y in zip(words.start[a].tolist(), words.end[a + WINDOW - 1].tolist())]
            yield {"doc": key[first + owner], "tag": tag[first + owner], "start": at, "words": held}

    def retiled(batch: pa.RecordBatch) -> Iterator[dict]:
        key, tag = _column(batch, "key"), _column(batch, "tag")
        for first, _, part, offsets in text_steps(batch.column("text")):
            words = Words(part, offsets)
            start, n, anchor, _ = _tiles(words)
            owner = words.doc[start] if len(start) else start
            yield {"doc": key[first + owner], "tag": tag[first + owner], "start": start - words.word_offsets[owner], "n": n, "anchor": anchor.view(np.int64)}

    spans = map_batches(rows.select("key", "tag", "text"), retiled, "doc long, tag int, start int, n int, anchor long").join(anchors, "anchor", "left_semi").distinct()
    lists = spans.groupBy(F.col("doc").alias("key"), "tag").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    held = map_batches(dealt.join(lists, ["key", "tag"]).select("key", "tag", "z", "marks"), cut_out, "doc long, tag int, start int, words string").distinct()
    first = F.min("doc").over(Window.partitionBy("words"))
    own = F.min("start").over(Window.partitionBy("words", "doc", "tag"))
    later = held.withColumn("first", first).withColumn("own", own).where("first < doc or own < start")
    none = F.lit(None).cast("long")
    return _by_text(later.select("doc", "tag", "start", F.lit(1).alias("n"), F.lit(KNOWN).alias("kind"), none.alias("sdoc"), none.cast("int").alias("stag"), none.cast("int").alias("sstart")), "exact")


def _factored(docs: DataFrame, text: str, rest: list[str], want_text: str) -> DataFrame:
    rows = _rows(docs, text, rest)
    marks = cut(_by_text(_marks(tiles(rows), True), "marks"))
    dealt = _dealt(rows)
    more = cut(_by_text(_marks(windows(dealt, marks), False), "more"))
    wanted = cut(asked(marks, "marks").unionByName(asked(more, "more")))
    out = cut(_parsed(dealt, [marks, more, None], pieces(dealt, wanted), want_text))
    refuted = out.select(F.explode("refuted").alias("anchor")).distinct()
    if refuted.head(1):  # words differ under one hash
        out = _parsed(dealt, [marks, more, cut(_exact(rows, dealt, refuted))], pieces(dealt, wanted), want_text)
    return out.drop("refuted")


def _text_of(z: pa.Array) -> pa.Array:
    return _unpacked(z).cast(pa.string())


def dedup(docs: DataFrame, text: str = "text", want_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, the removed word spans and kept_text (on demand)."""
    found = _factored(docs, text, [], "all" if want_text else "none")
    kept = F.arrow_udf(_text_of, "string")(F.col("z")) if want_text else F.lit(None).cast("string")
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", kept.alias("kept_text"), "spans")


def strip_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their duplicate spans cut out of the text (kept words, one space between).

    All other columns stay as they were, and so do texts that lose nothing;
    documents left without words stay, with an empty text.
    """
    rest = [c for c in docs.columns if c != text]
    found = _factored(docs, text, rest, "changed")
    held = F.col("rest")
    columns = [F.arrow_udf(_text_of, "string")(F.col("z")).alias(c) if c == text else held.getField(c).alias(c) for c in docs.columns]
    return found.select(*columns)
