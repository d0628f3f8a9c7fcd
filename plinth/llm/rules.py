"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the failure bits
beside the measurements.  A policy is a named, dated bitmask; applying one, or
asking what each rule alone removes, is bit arithmetic over the ledger and never
reads a text again.

Null texts count as empty.  An empty text has no words and fails ``few_words``.
Rows are independent of each other, so repeated rows give repeated results.
Documents keep whatever columns they have; the ledger carries ``doc_id`` only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, free_name, map_batches, named, range_hashes, same_ranges, word_steps

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER, _LOWER = (np.isin(np.arange(256), list(range(a, a + 26))) for a in (65, 97))
_NOT_TAIL = (np.arange(256) & 0xC0) != 0x80

#: First two bytes of the characters of scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han.
_UNSPACED = np.zeros(1 << 16, bool)
for _first, _last in ((0xE0B8, 0xE0BF), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE383), (0xE387, 0xE387), (0xE390, 0xE9BF), (0xEFA4, 0xEFAB), (0xEFBD, 0xEFBE), (0xF0A0, 0xF0B3)):
    for _lead in range(_first >> 8, (_last >> 8) + 1):
        _UNSPACED[max(_first, _lead << 8 | 0x80) : min(_last, _lead << 8 | 0xBF) + 1] = True

#: Bit of each rule, with its test on the measurements (all integer arithmetic).
RULES: list[tuple[str, Callable]] = [
    ("few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["word_chars"]),
    ("duplicate_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    # not where most characters are of scripts that do not part words
    ("long_words", lambda m: m["word_chars"] * m["is_spaced"] > 20 * m["n_words"]),
    # only where the letters with a known case are most of the letters
    ("shouting", lambda m: m["n_upper"] * m["is_cased"] > m["n_lower"]),
    ("unlettered", lambda m: 2 * m["n_letters"] < m["word_chars"]),
]
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: Versioned policies: the bits that reject.
POLICIES = {"v1": BASE, "v2": BASE | BITS["symbols"] | BITS["shouting"] | BITS["unlettered"], "v3": (1 << len(RULES)) - 1}
CURRENT = "v3"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_lower long, n_letters long, is_cased long, is_spaced long"


def repeated_words(words: Words, k: int = 5) -> np.ndarray:
    """Per document, the words in k-word windows that its text holds twice or more."""
    first, number = words.window_numbers(k)
    if not len(first):
        return np.zeros(words.n_docs, np.int64)
    key = number * words.n_docs + words.doc[first]
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    hit = first[order[same[1:] | same[:-1]]]
    return np.bincount(words.doc[words.covered(hit, hit + k)], minlength=words.n_docs)


def duplicate_lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per document, lines with a word, and those of them equal to an earlier line."""
    data = words.data
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(words.offsets[:-1], breaks + 1)
    start = start[start < len(data)]
    stop = np.searchsorted(breaks, start)
    end = np.append(breaks, len(data))[stop]
    doc = np.searchsorted(words.offsets, start, "right") - 1
    end = np.minimum(end, words.offsets[doc + 1])
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[filled], end[filled], doc[filled]
    lines = np.bincount(doc, minlength=words.n_docs)
    key = range_hashes(data, start, end)
    order = np.lexsort((key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    a, b = order[1:][same], order[:-1][same]
    if same_ranges(data, start[a], end[a], start[b], end[b]).all():
        return lines, np.bincount(doc[a], minlength=words.n_docs)
    # a hash met two lines: compare the lines themselves
    raw, seen, repeats = data.tobytes(), set(), np.zeros(words.n_docs, np.int64)
    for d, x, y in zip(doc.tolist(), start.tolist(), end.tolist()):
        repeats[d] += (d, raw[x:y]) in seen
        seen.add((d, raw[x:y]))
    return lines, repeats


def unspaced(words: Words) -> np.ndarray:
    """Per document, characters of scripts that do not part words."""
    data = words.data
    hit = np.zeros(len(data), bool)
    leads = np.flatnonzero(data[:-1] >= 0xE0)
    hit[leads] = _UNSPACED[data[leads].astype(np.uint16) << 8 | data[leads + 1]]
    return words.per_doc(hit)


def measure(words: Words) -> dict[str, np.ndarray]:
    data = words.data
    lines, duplicates = duplicate_lines(words)
    upper, lower = words.per_doc(_UPPER[data]), words.per_doc(_LOWER[data])
    chars = words.per_doc(words.inside & _NOT_TAIL[data])
    # lead bytes of multi-byte characters count as letters
    letters = upper + lower + words.per_doc(data >= 0xC0)
    return {
        "n_words": words.counts,
        "word_chars": chars,
        "n_symbols": words.per_doc(_SYMBOL[data]),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated_words(words),
        "n_lines": lines,
        "n_upper": upper,
        "n_lower": lower,
        "n_letters": letters,
        # 1 or 0, so that the tests stay arithmetic
        "is_cased": (2 * (upper + lower) > letters).astype(np.int64),
        "is_spaced": (2 * unspaced(words) <= chars).astype(np.int64),
    }


def measurements(text: Column) -> Column:
    """All measurements of a text, as one struct."""
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(MEASURES)

    @F.arrow_udf(kinds)
    def run(texts: pa.Array) -> pa.Array:
        parts = [measure(words) for _, _, words in word_steps(texts)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for n in kinds.names], kinds.names)

    return run(text)


def failed_bits(m: Column) -> Column:
    """Bit k: rule k of RULES fails."""
    bits: Column = F.lit(0).cast("long")
    for name, test in RULES:
        bits = bits.bitwiseOR(F.when(test(m), F.lit(BITS[name])).otherwise(0).cast("long"))
    return bits


def with_ledger(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The documents, all columns as they were, with one more that holds their ledger entry; and its name."""
    name = free_name(docs.columns, "ledger")
    rows = docs.select("*", measurements(named(text)).alias(name))
    return rows.withColumn(name, named(name).withField("failed_bits", failed_bits(named(name)))), name


def ledger(docs: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """keep, the measurements and ``failed_bits``."""
    rows, name = with_ledger(docs.select(named(keep), named(text)), text)
    return rows.select(named(keep), f"{name}.*")


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy; base failures are in every policy."""
    mask = POLICIES[policy] | BASE
    hit = lambda m: F.col("failed_bits").bitwiseAND(F.lit(m)) != 0
    return rows.withColumn("base_failed", hit(BASE)).withColumn("kept", ~hit(mask))


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects.

    The ledger is first reduced to counts per bitmask (at most 2**rules rows).
    """
    mask = POLICIES[policy] | BASE
    masks = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(b).cast("long").alias("bit")) for k, b in BITS.items() if b & mask])
    each = masks.select("bits", "n", F.explode(rules).alias("r"))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def filter_documents(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """Documents that a policy keeps, all columns as they were.

    The ledger travels in a column beside the document, so no join and no shuffle is needed.
    """
    mask = POLICIES[policy] | BASE
    rows, name = with_ledger(docs, text)
    return rows.where(named(name)["failed_bits"].bitwiseAND(F.lit(mask)) == 0).drop(name)
