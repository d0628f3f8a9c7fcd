"""Best-fit packing with bound-certified repacking.

Documents become token pieces of at most ``capacity`` ids.  Pieces are dealt to
groups of bounded size by a hash; each group packs its pieces by best-fit
decreasing and certifies its bin count with lower bounds from dual feasible
functions.  A certified group keeps its bins but the emptiest; a group above its
bound gives up every bin with a gap.  The pieces of those bins are dealt to fewer
groups and packed again, until the count meets the bound over them, one group has
seen them all, or ``ROUNDS`` are over.  Every row says how many bins its group
used and what the bound was.

Null texts are empty texts (one end id).  Equal texts are packed each for itself;
rows are never merged, so a repeated row is placed twice.  An empty table gives
an empty result.  Only ``doc_id`` and the text are read, whatever else there is.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, text_steps

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs.
GROUP_PIECES = 100_000
ROUNDS = 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, group_bins long, group_bound long, settled boolean"

#: Letters that lower-casing and composing change as Python does; a text of these and ASCII alone is cut by one pattern.
_LETTERS = "a-zß-öø-ÿ"
_OTHER = "[^\x00-\x7fÀ-ÖØ-öø-ÿ]"
#: The tokenizer's own cuts, for such texts in lower case.
_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+", re.A)
#: Controls that Python takes for white space and the tokenizer does not.
_CONTROL = re.compile("[\x1c-\x1f]")


class Memo:
    """Two generations of a bounded memory: what is not asked for again leaves with the older one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys not known; those of the older generation become young."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        out, old = [], self.old
        for k in keys.difference(self.young):
            if (value := old.get(k)) is None:
                out.append(k)
            else:
                self.young[k] = value
        return out


class WordTokenizer:
    """Ids of texts, memoised by pre-token.

    The tokenizer drops white space and cuts a text into letter runs, digits and
    marks before it merges, so a text's ids are those of its cuts in turn.  Texts
    with other characters or an added token are cut at white space and memoised by word.
    """

    #: Entries of a generation, of cuts and of words; some 200 bytes each.
    CUTS, WORDS = 500_000, 150_000
    #: Letter runs encoded as one text.
    RUN = 40
    _shared: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.cuts, self.words = Memo(self.CUTS), Memo(self.WORDS)
        # tokens that the tokenizer finds in a text before it cuts: none has white space in it
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([_OTHER, *map(re.escape, added)]))
        vocabulary = self.model.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def at(cls, path: str) -> "WordTokenizer":
        """One a Python worker."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_runs(self, cores: list[str]) -> list[bytes]:
        """As _encode, for lower-case letter runs: each ends with the one token of its ids that ends a word."""
        groups = [cores[k : k + self.RUN] for k in range(0, len(cores), self.RUN)]
        out: list[bytes] = []
        for group, e in zip(groups, self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts)] if len(cuts) == len(group) else self._encode(group)
        return out

    def _learn(self, cuts: set[str]) -> None:
        new = self.cuts.missing(cuts)
        runs = [w for w in new if w.isalpha()]
        self.cuts.young.update(zip(runs, self._encode_runs(runs)))
        rest = [w for w in new if not w.isalpha()]
        self.cuts.young.update(zip(rest, self._encode(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        other = [self.other.search(t) is not None for t in texts]
        cut = [None if o else _TOKEN.findall(t.lower()) for t, o in zip(texts, other)]
        self._learn(set().union(*filter(None, cut)))
        get = self.cuts.young.__getitem__
        out = [b"" if o else b"".join(map(get, c)) for o, c in zip(other, cut)]
        if any(other):
            at = [k for k, o in enumerate(other) if o]
            for k, ids in zip(at, self._encode_words([texts[k] for k in at])):
                out[k] = ids
        return out

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        """The same, for texts of any characters."""
        split = [None if _CONTROL.search(t) else t.split() for t in texts]
        new = self.words.missing(set().union(*filter(None, split)))
        plain = [w for w in new if not self.other.search(w)]
        cut = [_TOKEN.findall(w.lower()) for w in plain]
        self._learn(set().union(*cut))
        get = self.cuts.young.__getitem__
        self.words.young.update((w, b"".join(map(get, c))) for w, c in zip(plain, cut))
        rest = [w for w in new if self.other.search(w)]
        self.words.young.update(zip(rest, self._encode(rest)))
        get = self.words.young.__getitem__
        return [self._encode([t])[0] if words is None else b"".join(map(get, words)) for t, words in zip(texts, split)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token pieces of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        encoder, end = WordTokenizer.at(tokenizer), array("I", [END_ID]).tobytes()
        doc_ids = batch.column(0).to_pylist()
        for first, last, data, bounds in text_steps(batch.column(1)):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, ids in zip(doc_ids[first:last], encoder.encode(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    for column, value in zip(out.values(), (doc_id, k, at, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), run, PIECES)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best bin count that dual feasible functions prove.

    For a threshold e up to half the capacity: items above capacity - e count
    whole, items below e count nothing, others their share.  And for k = 1..20,
    the rounding functions: floor((k + 1) x) / k unless (k + 1) x is whole.
    """
    if not len(lengths):
        return 0
    x, c = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * c).sum()) // capacity)
    for e in np.unique(x[2 * x <= capacity]):
        whole, share = x > capacity - e, (x >= e) & (x <= capacity - e)
        best = max(best, -(-int(capacity * c[whole].sum() + (x * c)[share].sum()) // capacity))
    best = max(best, int(c[2 * x > capacity].sum()))
    for k in range(1, 21):
        y = (k + 1) * x
        scaled = np.where(y % capacity == 0, k * x, y // capacity * capacity)
        best = max(best, -(-int((scaled * c).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item (longest first, equals in turn), and the free space of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, free = 0, []
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        free[b] = left
        if left:
            open_at[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def given_up(free: np.ndarray, bound: int) -> np.ndarray:
    """Which bins of a group go on to be packed with those of other groups.

    None but the emptiest of a group that the bound certifies (a rest that another
    group may fill); every bin with a gap of a group above its bound.
    """
    out = np.zeros(len(free), bool)
    if len(free) > bound:
        out[free > 0] = True
    elif len(free) and free.max() > 0:
        out[free.argmax()] = True
    return out


def _pack_group(rows: pa.Table, capacity: int, base: int) -> pa.Table:
    rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    lengths = rows.column("length").to_numpy()
    bins, offsets, free = best_fit(lengths, capacity)
    bound = lower_bound(*np.unique(lengths, return_counts=True), capacity)
    sequence = base + (rows.column("group")[0].as_py() << 32) + bins
    rows = rows.drop_columns(["group"])
    same = lambda n: np.full(len(bins), n, np.int64)
    for name, values in (("sequence_id", sequence), ("offset", offsets), ("group_bins", same(len(free))), ("group_bound", same(bound)), ("settled", ~given_up(free, bound)[bins])):
        rows = rows.append_column(name, pa.array(values))
    return rows


def _packer(capacity: int, base: int):
    return lambda rows: _pack_group(rows, capacity, base)


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """PIECES rows with sequence_id, offset, and the bins and the bound of the group that packed them last.

    rows is read several times: cut it first.
    """
    done, todo = [], rows
    for turn in range(ROUNDS):
        histogram = todo.groupBy("length").count().toPandas()  # at most capacity rows
        n = int(histogram["count"].sum()) if len(histogram) else 0
        bound = lower_bound(histogram["length"].to_numpy(), histogram["count"].to_numpy(), capacity)
        groups = max(1, -(-n // group_pieces))
        dealt = todo.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(groups)).cast("long"))
        placed = cut(dealt.groupBy("group").applyInArrow(_packer(capacity, turn << 56), PLACED))
        used = placed.agg(F.count_distinct("sequence_id")).head()[0]
        # one group has seen every piece that is left: packing it again changes nothing
        if used <= bound or groups == 1 or turn == ROUNDS - 1:
            done.append(placed)
            break
        done.append(placed.where("settled"))
        todo = placed.where("not settled").select("doc_id", "piece", "start", "length", "ids_crc32")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("settled")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack_pieces(cut(pieces(docs, tokenizer, capacity, text)), capacity, group_pieces)
