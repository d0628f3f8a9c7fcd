"""Small hard tables and brute-force versions."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside themselves.
CLASHING = "keep string, fp long, e long, marks string, more string, key string, `group` long, score double, x string, y int, place int, host string, path string, label_id long, chosen_id long, rule_bits long, rank_score double, component_id long, doc long, span long, n long, ids string, length int, sequence_id long"


def sentences(rng, n, words=40):
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [" ".join(rng.choice(pool) for _ in range(words)) for _ in range(n)]


def hard_documents(spark):
    """Nulls in every column, empty and blank texts, a very long one, copies, repeated rows, clashing columns."""
    rng = random.Random(4)
    base = sentences(rng, 12)
    long_text = " ".join(sentences(rng, 400, 50))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(20, None, None, None, None), (21, "", "en", None, 0), (22, " \t\n ", None, "s", 3), (23, base[0], "en", "s", 1), (24, base[0] + " tail", "de", "s", 1)]
    rows += [(25, long_text, "en", "s", len(long_text)), (26, "é" * 3000 + " " + base[3], "fr", "s", 9), (27, "!!! 123 ...", "en", "s", 9), (None, base[1], "en", "s", 1), (None, None, None, None, None)]
    rows += [rows[2], rows[2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in CLASHING.split(", "):
        name, kind = part.rsplit(" ", 1)
        df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df.repartition(3)


def plain_documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, same = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            same += line in seen
            seen.add(line)
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), same, len(covered)


def brute_substrings(docs):
    """docs: {doc_id: text} to {doc_id: (n_words, n_removed, sha256)}."""
    seen, out = set(), {}
    for i in sorted(docs):
        words = WORD.findall(docs[i] or "")
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone |= set(range(k, k + 20))
            seen.add(window)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_components(ids, fingerprints, radius=4):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, fa in zip(ids, fingerprints):
        for b, fb in zip(ids, fingerprints):
            if a < b and bin(fa ^ fb).count("1") <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
