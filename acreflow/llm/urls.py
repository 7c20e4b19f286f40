"""URL filters over dated lists: a temporal join.

List entries are events: on a date a list adds or removes a domain, or a path prefix of it. Per list and target the
events become validity intervals [from, to), each as long as the next event leaves it. A capture asks with every
suffix of its host and every path prefix down to the depth that lists use, and finds the intervals that hold at its
fetch time: an as-of join, made an equality join on (domain, prefix, month) by cutting intervals at month ends, so
that a capture meets one interval a list and target, however often an entry changed. All in DataFrame functions.

Defined results: a null or unreadable URL has a null host and matches nothing; a null fetch time matches nothing;
of events of one list and target on one date the removal holds; captures that agree in id, URL and fetch time are
one; an empty list keeps everything. Hosts compare in lower case, without port, user or a trailing dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of cut intervals up to which they are broadcast; beyond, both sides are shuffled and AQE splits hot domains.
BROADCAST_ROWS = 200_000


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(events: DataFrame) -> DataFrame:
    """(list, domain, prefix, valid_from, valid_to) from events (list, domain, prefix, action add or remove, day).

    prefix: "" for all of a domain, or "/a/b" in whole segments. valid_to is null while an entry is on its list."""
    target = ["list", "domain", "prefix"]
    # A removal on the same day wins, and repeated events fall together.
    daily = events.groupBy(*target, "day").agg(F.max(F.col("action") == "remove").alias("removed"))
    after = F.lead("day").over(Window.partitionBy(*target).orderBy("day"))
    return daily.withColumn("valid_to", after).where(~F.col("removed")).select(*target, F.col("day").alias("valid_from"), "valid_to")


def by_month(spans: DataFrame, first: Column, last: Column) -> DataFrame:
    """Intervals cut at month ends, within the months of the captures."""
    start = F.trunc(F.greatest("valid_from", first), "month")
    end = F.trunc(F.least(F.coalesce(F.date_sub("valid_to", 1), last), last), "month")
    return spans.where(start <= end).withColumn("month", F.explode(F.sequence(start, end, F.expr("interval 1 month"))))


def screened(captures: DataFrame, events: DataFrame) -> DataFrame:
    """(id, url, fetched, host, blocked, n_entries, lists) for captures (id, url, fetched date)."""
    kept = captures.select("id", "url", "fetched", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    spans = intervals(events)
    bounds = captures.agg(F.min("fetched").alias("first"), F.max("fetched").alias("last")).first()
    depth = spans.agg(F.max(F.size(F.split("prefix", "/")) - 1)).first()[0] or 0
    cut = by_month(spans, F.lit(bounds["first"]), F.lit(bounds["last"]))
    cut = F.broadcast(cut) if cut.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else cut
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth + 1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    asked = kept.where("host is not null and fetched is not null").select("id", "url", "fetched", "path", F.explode(suffixes).alias("domain"), F.trunc("fetched", "month").alias("month"))
    asked = asked.select("id", "url", "fetched", "domain", "month", F.explode(F.array_distinct(prefixes)).alias("prefix"))
    holds = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    hits = asked.join(cut, ["domain", "prefix", "month"]).where(holds)
    # A marker row for every capture rides along, so that one grouping gives those without hits too.
    none = F.lit(None).cast("string")
    every = kept.select("id", "url", "fetched", "host", none.alias("list"), none.alias("target"))
    found = hits.select("id", "url", "fetched", none.alias("host"), "list", F.concat("domain", "prefix").alias("target"))
    counts = every.unionByName(found).groupBy("id", "url", "fetched").agg(
        F.max("host").alias("host"), F.count_distinct("list", "target").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")
    )
    return counts.select("id", "url", "fetched", "host", (F.col("n_entries") > 0).alias("blocked"), "n_entries", "lists")
