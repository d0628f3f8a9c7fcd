"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word, led by a space, in both directions, and
gives every byte position a distribution over languages.  It is trained in numpy
by backpropagation through time on words of a bounded sample of documents (see
``learn``; held-out ids excluded).
A document's log probabilities are pooled over all positions of all its words that
hold a letter.  A word's position labels depend on nothing outside it, so sums are
memoised by word.  Words above ``PIECE`` bytes are read in pieces; nothing is cut.

Null texts and texts without a letter are ``und`` with score 0.  Without anything
to learn from, all are.  A repeated row repeats its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, named, text_steps

UNKNOWN = "und"
#: The fitting sample: documents a language, languages, documents in all and characters of a document at most.
SAMPLE, LANGUAGES, DOCUMENTS, FIT_CHARS = 300, 256, 20_000, 16_384
HIDDEN, INPUT, STEPS, BATCH, PIECE = 16, 12, 500, 256, 48
#: Positions whose mean log probabilities count in full in a score.
SHARP = 16.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """One gated recurrent layer: update gate z, reset gate r, candidate n."""

    NAMES = ("w", "u", "c", "b")

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int):
        scale = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = scale(inputs, 3 * hidden)
        self.u = scale(hidden, 2 * hidden)
        self.c = scale(hidden, hidden)
        self.b = np.zeros(3 * hidden, np.float32)

    def forward(self, x: np.ndarray, keep: bool = False):
        """x: (steps, batch, 3 * hidden), the projected inputs.  All states, and what the gradient needs."""
        hidden = len(self.c)
        h = np.zeros((x.shape[1], hidden), np.float32)
        states, kept = np.empty((*x.shape[:2], hidden), np.float32), []
        for t in range(len(x)):
            gates = _sigmoid(x[t, :, : 2 * hidden] + h @ self.u)
            z, r = gates[:, :hidden], gates[:, hidden:]
            n = np.tanh(x[t, :, 2 * hidden :] + (r * h) @ self.c)
            if keep:
                kept.append((h, z, r, n))
            h = n + z * (h - n)
            states[t] = h
        return states, kept

    def backward(self, d_states: np.ndarray, kept: list) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the projected inputs and of u and c, through time."""
        hidden = len(self.c)
        dx = np.empty((*d_states.shape[:2], 3 * hidden), np.float32)
        du, dc = np.zeros_like(self.u), np.zeros_like(self.c)
        dh = np.zeros(d_states.shape[1:], np.float32)
        for t in range(len(d_states) - 1, -1, -1):
            h, z, r, n = kept[t]
            dh = dh + d_states[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            back = dn @ self.c.T
            dr = back * h * r * (1 - r)
            dc += (r * h).T @ dn
            gates = np.concatenate([dz, dr], 1)
            du += h.T @ gates
            dx[t, :, : 2 * hidden], dx[t, :, 2 * hidden :] = gates, dn
            dh = dh * z + back * r + gates @ self.u.T
        return dx, {"u": du, "c": dc}


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, inputs: int = INPUT, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.standard_normal((256, inputs)).astype(np.float32) * 0.5
        self.ahead, self.behind = Direction(rng, inputs, hidden), Direction(rng, inputs, hidden)
        self.out = (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _parameters(self) -> list[tuple[object, str]]:
        return [(self, "embed"), (self, "out"), (self, "bias")] + [(d, n) for d in (self.ahead, self.behind) for n in Direction.NAMES]

    def labels(self, words: np.ndarray) -> np.ndarray:
        """Log probabilities (length, batch, languages) of every byte of words of one length."""
        steps = words.T
        states = []
        for direction, order in ((self.ahead, steps), (self.behind, steps[::-1])):
            table = self.embed @ direction.w + direction.b
            states.append(direction.forward(table[order])[0])
        logits = np.concatenate([states[0], states[1][::-1]], 2) @ self.out + self.bias
        top = logits.max(2, keepdims=True)
        return logits - top - np.log(np.exp(logits - top).sum(2, keepdims=True))

    def gradient(self, words: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions, and its gradient for _parameters()."""
        steps, count = words.T, words.size
        runs = []
        for direction, order in ((self.ahead, steps), (self.behind, steps[::-1])):
            x = self.embed[order]
            runs.append((direction, order, x, *direction.forward(x @ direction.w + direction.b, keep=True)))
        joined = np.concatenate([runs[0][3], runs[1][3][::-1]], 2)
        logits = joined @ self.out + self.bias
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        loss = float(-np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-12)).mean())
        p[:, np.arange(len(y)), y] -= 1
        p /= count
        flat = lambda a: a.reshape(-1, a.shape[-1])
        d_out, d_bias = flat(joined).T @ flat(p), flat(p).sum(0)
        d_joined = p @ self.out.T
        hidden = len(self.ahead.c)
        d_embed, grads = np.zeros_like(self.embed), []
        for (direction, order, x, _, kept), d in zip(runs, (d_joined[:, :, :hidden], d_joined[::-1, :, hidden:])):
            dx, g = direction.backward(d, kept)
            np.add.at(d_embed, order.reshape(-1), flat(dx) @ direction.w.T)
            grads.append({"w": flat(x).T @ flat(dx), "b": flat(dx).sum(0), **g})
        return loss, [d_embed, d_out, d_bias] + [g[n] for g in grads for n in Direction.NAMES]

    def train(self, by_language: list[list[bytes]], steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 5) -> None:
        """Adam over batches of words of one length; languages are drawn evenly, words by their frequency."""
        rng = np.random.default_rng(seed)
        pools: dict[int, list[np.ndarray]] = {}
        mass: dict[int, int] = {}
        for k, words in enumerate(by_language):
            sizes = np.array([len(w) for w in words])
            for length in np.unique(sizes):
                rows = np.frombuffer(b"".join(w for w in words if len(w) == length), np.uint8).reshape(-1, length)
                pools.setdefault(int(length), [None] * len(by_language))[k] = rows
                mass[int(length)] = mass.get(int(length), 0) + rows.size
        lengths = np.array(sorted(mass))
        odds = np.array([mass[n] for n in lengths], float)
        odds /= odds.sum()
        m = [np.zeros_like(getattr(o, n)) for o, n in self._parameters()]
        v = [np.zeros_like(a) for a in m]
        for step in range(1, steps + 1):
            pool = [(k, rows) for k, rows in enumerate(pools[int(rng.choice(lengths, p=odds))]) if rows is not None]
            per = max(1, batch // len(pool))
            words = np.concatenate([rows[rng.integers(0, len(rows), per)] for _, rows in pool])
            y = np.repeat([k for k, _ in pool], per)
            _, grads = self.gradient(words, y)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, ((owner, name), g) in enumerate(zip(self._parameters(), grads)):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                step_size = lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                setattr(owner, name, (getattr(owner, name) - step_size).astype(np.float32))


def pieces(word: str) -> list[bytes]:
    """The bytes of a word led by a space, in pieces of at most PIECE."""
    b = b" " + word.encode()
    return [b[k : k + PIECE] for k in range(0, len(b), PIECE)]


class Reader:
    """A network with memoised word sums."""

    #: Words kept; some 150 bytes each.
    LIMIT = 400_000
    _shared: dict[str, "Reader"] = {}

    def __init__(self, network: Network):
        self.network = network
        self.clear()

    @classmethod
    def of(cls, token: str, network: Network) -> "Reader":
        """One a Python worker for each trained network; the newest only."""
        if token not in cls._shared:
            cls._shared = {token: cls(network)}
        return cls._shared[token]

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.sums = np.zeros((1 << 12, len(self.network.languages) + 1), np.float32)

    def _learn(self, words: list[str]) -> None:
        need = len(self.row) + len(words)
        if need > len(self.sums):
            grown = np.zeros((max(need, 2 * len(self.sums)), self.sums.shape[1]), np.float32)
            grown[: len(self.sums)] = self.sums
            self.sums = grown
        by_length: dict[int, tuple[list[bytes], list[int]]] = {}
        for w in words:
            k = self.row[w] = len(self.row)
            if any(map(str.isalpha, w)):
                for p in pieces(w):
                    found = by_length.setdefault(len(p), ([], []))
                    found[0].append(p)
                    found[1].append(k)
        for length, (parts, rows) in by_length.items():
            block = max(1, (1 << 16) // length)
            for at in range(0, len(parts), block):
                data = np.frombuffer(b"".join(parts[at : at + block]), np.uint8).reshape(-1, length)
                np.add.at(self.sums[:, :-1], rows[at : at + block], self.network.labels(data).sum(0))
                np.add.at(self.sums[:, -1], rows[at : at + block], np.float32(length))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if len(self.row) > self.LIMIT:
            self.clear()
        split = [t.split() for t in texts]
        row = self.row
        self._learn([w for w in set().union(*split) if w not in row])
        languages, scores = [], np.zeros(len(texts))
        for k, words in enumerate(split):
            total = self.sums[[row[w] for w in words]].sum(0, dtype=np.float64) if words else np.zeros(self.sums.shape[1])
            if not total[-1]:
                languages.append(UNKNOWN)
                continue
            x = total[:-1] / max(1.0, total[-1] / SHARP)
            p = np.exp(x - x.max())
            best = int(p.argmax())
            languages.append(self.network.languages[best])
            scores[k] = p[best] / p.sum()
        return languages, scores


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, steps: int = STEPS) -> Network | None:
    """A network trained on documents that are not held out and have a language.

    The fitting sample is bounded: of the LANGUAGES languages with most documents each
    gives ``sample`` documents (fewer if all together would pass DOCUMENTS), the least
    by a hash of the id, and each document its first FIT_CHARS characters.
    """
    known = docs.select("doc_id", named(lang).alias("lang"), named(text).alias("text"))
    usable = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return None
    each = max(1, min(sample, DOCUMENTS // len(sizes)))
    # twice as many as are wanted pass by their hash, so that no language has to be sorted; the rest is cut here
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 2 * (each + 20) / r.n)) for r in sizes], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = usable.join(F.broadcast(share), "lang").where(place < F.col("share"))
    # of several texts under one id and language one teaches
    rows = rows.groupBy("lang", "doc_id").agg(F.min(F.left("text", F.lit(FIT_CHARS))).alias("text"))
    by: dict[str, list[tuple]] = {}
    for r in rows.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", "text").toLocalIterator():
        by.setdefault(r.lang, []).append((r.h % (1 << 30), r.doc_id, r.text))
    parts = {k: [p for _, _, t in sorted(v)[:each] for w in t.split() if any(map(str.isalpha, w)) for p in pieces(w)] for k, v in by.items()}
    parts = {k: v for k, v in parts.items() if v}
    if not parts:
        return None
    network = Network(sorted(parts))
    network.train([parts[k] for k in network.languages], steps)
    return network


def identify(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score."""
    import uuid

    kind = docs.schema["doc_id"].dataType.simpleString()
    if network is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    token = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        reader = Reader.of(token, network)
        for first, last, data, bounds in text_steps(batch.column("text")):
            raw, b = data.tobytes(), bounds.tolist()
            languages, scores = reader.predict([raw[x:y].decode() for x, y in zip(b[:-1], b[1:])])
            yield {"doc_id": batch.column("doc_id")[first:last], "lang_pred": languages, "score": scores}

    return map_batches(docs.select("doc_id", named(text).alias("text")), run, f"doc_id {kind}, lang_pred string, score double")


def label_positions(text: str, network: Network) -> list[str]:
    """The language label of every byte of a text; white space belongs to no word and has none."""
    out: list[str] = []
    data, at = text.encode(), 0
    for word in text.split():
        b = word.encode()
        start = data.index(b, at)
        out += [""] * (start - at)
        labels = np.concatenate([network.labels(np.frombuffer(p, np.uint8).reshape(1, -1))[:, 0] for p in pieces(word)]).argmax(1)[1:]
        out += [network.languages[k] for k in labels]
        at = start + len(b)
    return out + [""] * (len(data) - at)
