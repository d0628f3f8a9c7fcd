"""Byte-level BPE encoding and decoding with recursive DuckDB queries.

Texts are cut into pieces by the vocabulary's pattern.  Each Python worker keeps
one DuckDB database with the merge table; the distinct pieces that it has not met
become token-position rows, and a recursive query contracts the leftmost
minimum-rank pair of every piece at once until nothing changes.  Ids decode by an
ordered aggregation of the tokens' bytes.

A piece that is itself a token is that token, as the tiktoken library has it.
Longer pieces are first cut where two bytes meet that no token holds side by side:
no merge ever crosses such a place, so the parts contract each for itself, and text
without spaces comes down to short parts that recur.  The query's rounds times rows
grow with the square of a part's length, so it takes as many parts at a time as keep
that within ``STEPS``; a part above ``LONG`` bytes (one run of letters, say) goes
through a heap, with the same result.

Null texts are empty: no ids, the digest of nothing.  Every row is encoded for
itself, so repeated rows repeat results.  Lone surrogates cannot occur in UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_steps

if TYPE_CHECKING:
    import numpy as np

LONG, SHORT = 128, 32
#: Rows times rounds, and parts, of one query.
STEPS, PARTS = 1 << 21, 20_000
#: Letters and a tail of marks: after a space, one or two pieces by the usual pattern (a codec tries it out first).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|%&*#$]*)")
MEMORY = "400MB"
#: Bytes of text encoded at a time: a round of the query costs the same for few pieces as for many.
STEP = 4 << 20
#: Words whose ids are gathered at a time.
GATHER = 1 << 18

#: Contracts the leftmost minimum-rank pair of each piece until none is left.  A row knows the position of the
#: next one (as does the one that is gone), so neighbours meet by a join and nothing is sorted before the end.
CONTRACT = """
WITH RECURSIVE state(round, piece, pos, next, token) AS (
    SELECT 0, piece, pos, pos + 1, token FROM start
  UNION ALL
    (WITH best AS (
        SELECT a.piece, min((m.merged::BIGINT << 32) | a.pos) AS pick,
               arg_min((b.pos::BIGINT << 32) | b.next, (m.merged::BIGINT << 32) | a.pos) AS gone
        FROM state a
        JOIN state b ON ((a.piece::BIGINT << 32) | a.next) = ((b.piece::BIGINT << 32) | b.pos)
        JOIN merges m ON ((a.token::BIGINT << 32) | b.token) = m.pair
        GROUP BY a.piece
     )
     SELECT s.round + 1, s.piece, s.pos,
            CASE WHEN s.pos = b.pick & 4294967295 THEN (b.gone & 4294967295)::INT ELSE s.next END,
            CASE WHEN s.pos = b.pick & 4294967295 THEN (b.pick >> 32)::INT ELSE s.token END
     FROM state s JOIN best b ON s.piece = b.piece
     WHERE s.pos <> b.gone >> 32)
), last AS (SELECT piece, max(round) AS round FROM state GROUP BY piece)
SELECT s.piece, list(s.token ORDER BY s.pos) AS ids
FROM state s JOIN last l ON s.piece = l.piece AND s.round = l.round
GROUP BY s.piece
"""

#: Bytes of each text's ids in their order, a character of that number for each byte.
DECODE = """
SELECT i.doc, array_to_string(list(t.chars ORDER BY i.pos), '') AS chars
FROM ids i JOIN tokens t ON i.token = t.token
GROUP BY i.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """All (left, right, merged) ids whose bytes join to a token."""
    first, second, merged = [], [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                first.append(a), second.append(b), merged.append(rank)
    return first, second, merged


def heap_encode(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction, in n log n steps, for long pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    alive, queue = [True] * len(parts), []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (rank := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(queue, (rank, i, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or j >= len(parts) or parts[i] != left or parts[j] != right:
            continue
        parts[i], alive[j], after[i] = left + right, False, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p, a in zip(parts, alive) if a]


class Codec:
    """One a Python worker: the database, and memoised pieces and space-led chunks."""

    #: Entries kept; some 200 bytes each.
    LIMIT, LIMIT_PIECES = 600_000, 1_000_000
    _shared: dict[tuple[str, str], "Codec"] = {}
    #: A space before another white space or the end: such texts are cut by the pattern alone.
    _LOOSE = re.compile(r" (?=\s|\Z)")

    def __init__(self, path: str, pattern: str):
        import duckdb
        import numpy as np
        import regex

        self.pattern = regex.compile(pattern)
        self.plain = _PLAIN if all(self.pattern.findall(f" {a}{b}") == [f" {a}", *filter(None, [b])] for a in ("ab", "Éaß", "z") for b in ("", ".", "!?,", "|%&*#$", ";:")) else re.compile(r"(?!)")
        self.ranks = read_ranks(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        first, second, merged = merges(self.ranks)
        table = pa.table({"first": pa.array(first, pa.int32()), "second": pa.array(second, pa.int32()), "merged": pa.array(merged, pa.int32())})
        self.db.register("m", table)
        self.db.execute("CREATE TABLE merges AS SELECT (first::BIGINT << 32) | second AS pair, merged FROM m")
        tokens = pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "chars": [t.decode("latin-1") for t in self.ranks]})
        self.db.register("t", tokens)
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM t")
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.side_by_side = np.zeros(1 << 16, bool)
        for t in self.ranks:
            b = np.frombuffer(t, np.uint8).astype(np.int32)
            self.side_by_side[b[:-1] << 8 | b[1:]] = True
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in cls._shared:
            cls._shared[path, pattern] = cls(path, pattern)
        return cls._shared[path, pattern]

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of pieces, by the recursive query."""
        import numpy as np

        sizes = np.array([len(p) for p in pieces], np.int64)
        total = int(sizes.sum())
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = pa.table(
            {
                "piece": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes),
                "pos": (np.arange(total) - first).astype(np.int32),
                "token": self.single[np.frombuffer(b"".join(pieces), np.uint8)],
            }
        )
        self.db.register("start", start)
        found = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("start")
        lists = found.column("ids").combine_chunks()
        ends = (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
        raw = lists.values.to_numpy().astype("<u4").tobytes()
        out = [b""] * len(pieces)
        for k, x, y in zip(found.column("piece").to_pylist(), ends, ends[1:]):
            out[k] = raw[x:y]
        return out

    def cut(self, piece: bytes) -> list[bytes]:
        """The parts of a piece that no merge joins."""
        import numpy as np

        b = np.frombuffer(piece, np.uint8).astype(np.int32)
        at = [0, *(np.flatnonzero(~self.side_by_side[b[:-1] << 8 | b[1:]]) + 1).tolist(), len(piece)]
        return [piece[x:y] for x, y in zip(at, at[1:])]

    def _contracted(self, parts: list[bytes]) -> Iterator[bytes]:
        """Ids of parts, as many at a time as the query may hold."""
        first, steps = 0, 0
        for k, p in enumerate(parts):
            steps += len(p) * len(p)
            if k + 1 == len(parts) or k + 1 - first == PARTS or steps + len(parts[k + 1]) ** 2 > STEPS:
                yield from self.contract(parts[first : k + 1])
                first, steps = k + 1, 0

    def _learn(self, pieces: set[str]) -> None:
        if len(self.pieces) > self.LIMIT_PIECES:
            self.pieces = {}
        if len(self.parts) > self.LIMIT:
            self.parts = {}
        todo: list[str] = []
        short: list[bytes] = []
        long: dict[str, list[bytes]] = {}
        for p in pieces:
            if p not in self.pieces:
                b = p.encode()
                if (rank := self.ranks.get(b)) is not None:
                    self.pieces[p] = array("I", [rank]).tobytes()
                elif len(b) > SHORT:
                    long[p] = self.cut(b)
                else:
                    todo.append(p)
                    short.append(b)
        self.pieces.update(zip(todo, self._contracted(short)))
        if long:
            parts = set().union(*long.values()).difference(self.parts)
            self.parts.update((b, array("I", heap_encode(b, self.ranks)).tobytes()) for b in parts if len(b) > LONG)
            rest = [b for b in parts if len(b) <= LONG]
            self.parts.update(zip(rest, self._contracted(rest)))
            get = self.parts.__getitem__
            self.pieces.update((p, b"".join(map(get, found))) for p, found in long.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.encode_flat(texts)
        raw, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [raw[x:y] for x, y in zip(ends, ends[1:])]

    def encode_flat(self, texts: list[str]) -> tuple["np.ndarray", "np.ndarray"]:
        """The ids of all texts one after another, and where each text's begin (and the last end)."""
        import numpy as np

        if len(self.chunks) > self.LIMIT:
            self.chunks = {}
        # where every space leads a word, pieces never reach across one: cut there and memoise
        loose = [self._LOOSE.search(t) is not None for t in texts]
        split = pc.split_pattern(pa.array(["" if x else t for t, x in zip(texts, loose)], pa.large_string()), " ")
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        # the word before the first space has none to lead it, and a loose text has no other word: those come after the led words
        word = coded.indices.to_numpy().astype(np.int64)
        led_ones = np.ones(len(word), bool)
        led_ones[first[:-1]] = False
        known = coded.dictionary.to_pylist()
        heads = [known[k] for k in word[first[:-1]].tolist()]
        led = [known[k] for k in np.flatnonzero(np.bincount(word[led_ones], minlength=len(known))).tolist()]
        word[first[:-1]] = len(known) + np.arange(len(texts))

        chunks, find, plain = self.chunks, self.pattern.findall, self.plain.fullmatch
        head_pieces = [find(t if x else h) for t, x, h in zip(texts, loose, heads)]
        fresh = []
        for w in led:
            if w not in chunks:
                m = plain(w)
                fresh.append((w, (f" {m[1]}", m[2]) if m and m[2] else (f" {w}",) if m else find(f" {w}")))
        self._learn({p for _, ps in fresh for p in ps}.union(*head_pieces))
        pieces = self.pieces.__getitem__
        for w, ps in fresh:
            chunks[w] = b"".join(map(pieces, ps))
        parts = [chunks.get(w, b"") for w in known] + [b"".join(map(pieces, ps)) for ps in head_pieces]

        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        start = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(parts), np.dtype("<i4")).astype(np.int32, copy=False)
        total = np.concatenate([[0], np.cumsum(size[word])])
        ids = np.empty(total[-1], np.int32)
        for k in range(0, len(word), GATHER):
            some = word[k : k + GATHER]
            ends = total[k : k + len(some) + 1]
            ids[ends[0] : ends[-1]] = pool[np.arange(ends[0], ends[-1]) + np.repeat(start[some] - ends[:-1], size[some])]
        return ids, total[first]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each id list."""
        import numpy as np

        sizes = np.array([len(e) // 4 for e in encoded], np.int64)
        return self.decode_flat(np.frombuffer(b"".join(encoded), np.int32), np.concatenate([[0], np.cumsum(sizes)]))

    def decode_flat(self, ids: "np.ndarray", ends: "np.ndarray") -> list[bytes]:
        """Bytes of each text's ids, which are joined to the token table and aggregated in order."""
        import numpy as np

        doc = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
        self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int32), "token": ids}))
        found = self.db.execute(DECODE).fetchall()
        self.db.unregister("ids")
        out = [b""] * (len(ends) - 1)
        for k, text in found:
            out[k] = text.encode("latin-1")
        return out


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", want_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of what they decode to, and the ids (on demand)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        import numpy as np

        codec = Codec.at(ranks, pattern)
        for first, last, data, bounds in text_steps(batch.column("text"), STEP):
            raw, b = data.tobytes(), bounds.tolist()
            ids, ends = codec.encode_flat([raw[x:y].decode() for x, y in zip(b[:-1], b[1:])])
            bytes_of, e = ids.astype("<u4").data, ends.tolist()
            yield {
                "doc_id": batch.column("doc_id")[first:last],
                "n_tokens": np.diff(ends),
                "ids_sha256": [hashlib.sha256(bytes_of[x:y]).hexdigest() for x, y in zip(e, e[1:])],
                "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in codec.decode_flat(ids, ends)],
                "ids": [ids[x:y] if want_ids else None for x, y in zip(e, e[1:])],
            }

    return map_batches(docs.select("doc_id", F.col(text).alias("text")), run, f"doc_id {kind}, {SCHEMA}")


def decode(rows: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """doc_id and the text of its ids; bytes that are not UTF-8 become replacement characters."""
    import numpy as np

    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        codec = Codec.at(ranks, pattern)
        lists = [np.array(x or [], np.int32).tobytes() for x in batch.column("ids").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "text": [d.decode(errors="replace") for d in codec.decode(lists)]}

    return map_batches(rows.select("doc_id", F.col(ids).alias("ids")), run, f"doc_id {kind}, text string")
