"""Queries opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, htmltext, langid, packing, ranking, rules, simhash, substring, topk, urllists
from .common import held_out, table
from .hosts import host_of


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.dedup(table(spark, folder, "documents"), want_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

def list_events(pages: DataFrame) -> DataFrame:
    """The dated list of the query: day, seq, action, domain, category, for every host of the pages and every domain above one.

    The table has no list, so days and categories are arithmetic on the ids of a
    domain's pages: added, removed, and renewed twice on one day with a change of category.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host"), "page_id").where("host is not null")
    above = hosts.select(F.regexp_replace("host", r"^[^.]*\.", "").alias("domain"), "page_id", "host").where("domain <> host and domain <> ''")
    sums = [F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.count("*").alias("n")]
    day = lambda days: F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    event = lambda at, seq, action, category: F.struct(day(at).alias("day"), F.lit(seq).alias("seq"), F.lit(action).alias("action"), category.cast("string").alias("category"))
    none = F.lit(None)
    own = [
        event(F.pmod(a * 7, F.lit(366)), 0, "add", F.concat(F.lit("c"), F.pmod(a, F.lit(5)))), event(F.pmod(a * 7, F.lit(366)) + 40, 1, "remove", none),
        event(F.pmod(b * 13, F.lit(366)), 2, "add", F.concat(F.lit("d"), F.pmod(n, F.lit(3)))), event(F.pmod(b * 13, F.lit(366)), 3, "add", F.lit("e")),
    ]
    shared = [event(F.pmod(a * 3, F.lit(366)), 4, "add", F.lit("parent")), event(F.pmod(b * 5, F.lit(366)), 5, "remove", none)]
    each = lambda rows, events: rows.select("domain", F.explode(F.array(*events)).alias("e")).select("domain", "e.*")
    return each(hosts.groupBy(F.col("host").alias("domain")).agg(*sums), own).unionByName(each(above.groupBy("domain").agg(*sums), shared))


def op6_url_temporal(spark: SparkSession, folder: str) -> DataFrame:
    """Captures are the pages, fetched on day page_id mod 366 of 2024 (the table has no time of its own)."""
    pages = table(spark, folder, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    return urllists.evaluate(pages.withColumn("day", day), list_events(pages))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS day,
         nullif(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1)), '\.+$', ''), '') AS host
  FROM pages
), h AS (
  SELECT host AS domain, min(page_id) AS a, max(page_id) AS b, count(*) AS n FROM p WHERE host IS NOT NULL GROUP BY 1
), u AS (
  SELECT domain, min(page_id) AS a, max(page_id) AS b
  FROM (SELECT regexp_replace(host, '^[^.]*\.', '') AS domain, host, page_id FROM p) WHERE domain <> host AND domain <> '' GROUP BY 1
), events AS (
  SELECT domain, a * 7 % 366 AS d, 0 AS seq, 'add' AS action, concat('c', a % 5) AS category FROM h
  UNION ALL SELECT domain, a * 7 % 366 + 40, 1, 'remove', NULL FROM h
  UNION ALL SELECT domain, b * 13 % 366, 2, 'add', concat('d', n % 3) FROM h
  UNION ALL SELECT domain, b * 13 % 366, 3, 'add', 'e' FROM h
  UNION ALL SELECT domain, a * 3 % 366, 4, 'add', 'parent' FROM u
  UNION ALL SELECT domain, b * 5 % 366, 5, 'remove', NULL FROM u
), i AS (
  SELECT domain, action, category, CAST(DATE '2024-01-01' + CAST(d AS INTEGER) AS DATE) AS valid_from,
         CAST(DATE '2024-01-01' + CAST(lead(d) OVER (PARTITION BY domain ORDER BY d, seq) AS INTEGER) AS DATE) AS valid_to
  FROM events
), labels_of AS (
  SELECT page_id, host, day, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM p WHERE host IS NOT NULL
), asked AS (
  SELECT page_id, day, array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.') AS domain FROM labels_of
), m AS (
  SELECT q.page_id, i.domain, i.category, i.valid_from, row_number() OVER (PARTITION BY q.page_id ORDER BY length(i.domain) DESC) AS r, count(*) OVER (PARTITION BY q.page_id) AS n
  FROM asked q JOIN i ON i.action = 'add' AND q.domain = i.domain AND i.valid_from <= q.day AND (i.valid_to IS NULL OR q.day < i.valid_to)
)
SELECT p.page_id, p.host, p.day, m.n IS NOT NULL AS blocked, CAST(coalesce(m.n, 0) AS BIGINT) AS n_active,
       m.domain AS listed_domain, m.category, m.valid_from AS listed_from
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.r = 1
"""


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op8_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = rules.apply_policy(rules.ledger(table(spark, folder, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = bpe.encode(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, want_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_quality_ranking(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = ranking.score(docs, ranking.learn(docs, table(spark, folder, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_language_id": op3_language_id,
        "op4_simhash": op4_simhash,
        "op5_exact_topk": op5_exact_topk,
        "op6_url_temporal": op6_url_temporal,
        "op7_html_text": op7_html_text,
        "op8_rule_ledger": op8_rule_ledger,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_quality_ranking": op10_quality_ranking,
    }


def oracle_sql() -> dict[str, str]:
    """The others have no SQL and are tested against brute force in tests/llm."""
    return {"op5_exact_topk": OP5_SQL, "op6_url_temporal": OP6_SQL}
