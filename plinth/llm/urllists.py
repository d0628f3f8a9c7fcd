"""URL filters as a temporal list join.

A list is a log of dated events (day, action, domain, category): an entry holds
from the day it is added until the day it is removed or changed.  Events become
validity intervals; a capture is evaluated by an as-of join against the entries
of its host and of every domain above it that were active on its day.

Defined cases: several events of one domain on one day count in the order of
``seq``; removing what is not listed does nothing; an add while listed renews the
entry with its category.  A capture without a URL, host or day matches nothing and
stays in the result.  Repeated captures give repeated results, repeated events
change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .hosts import host_of

#: Interval lists up to this many rows are broadcast; longer ones are joined by domain.
BROADCAST_ROWS = 100_000


def intervals(events: DataFrame) -> DataFrame:
    """domain, category, valid_from, valid_to (null: still valid), from day, seq, action, domain, category."""
    known = events.where("domain is not null and day is not null").select(F.lower(F.trim("domain")).alias("domain"), "day", "seq", "action", "category").distinct()
    order = Window.partitionBy("domain").orderBy("day", "seq", "action", "category")
    until = known.withColumn("valid_to", F.lead("day").over(order))
    live = until.where((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("day"))))
    return live.select("domain", "category", F.col("day").alias("valid_from"), "valid_to")


def suffixes(host) -> "F.Column":
    """The host and every domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def evaluate(captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url", day: str = "day") -> DataFrame:
    """key, host, day, blocked, n_active, and the longest listed domain with its category and interval.

    Captures are joined once per distinct (host, day), so a host with a third of
    all captures meets the list once a day, and its rows are tied on by a join
    that can be split.
    """
    rows = captures.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), F.col(day).alias("day"))
    asked = cut(rows.where("host is not null and day is not null").groupBy("host", "day").agg(F.count("*").alias("n_captures")))
    spans = cut(intervals(events))
    side = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans
    probes = asked.select("host", "day", F.explode(suffixes(F.col("host"))).alias("domain"))
    active = probes.join(side, "domain").where("valid_from <= day and (valid_to is null or day < valid_to)")
    best = F.max_by(F.struct("domain", "category", "valid_from"), F.length("domain")).alias("best")
    verdicts = active.groupBy("host", "day").agg(F.count("*").alias("n_active"), best)
    joined = rows.join(verdicts, ["host", "day"], "left")
    return joined.select(
        F.col("key").alias(key),
        "host",
        "day",
        F.col("n_active").isNotNull().alias("blocked"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.domain").alias("listed_domain"),
        F.col("best.category").alias("category"),
        F.col("best.valid_from").alias("listed_from"),
    )
