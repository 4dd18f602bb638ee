"""URL filtering by dated lists: entries become validity intervals, captures are joined as of their fetch time.

List events are (list, kind, value, action, at): ``list`` is 'block' or 'allow'; ``kind`` is 'domain' (a host and all below
it), 'host' (that host alone) or 'url' (one page); ``action`` is 'add' or 'remove'. For each entry the events in order of time
(a removal before an addition at the same time) give half-open intervals [from, to) in which it is active; an addition while
active or a removal while inactive changes nothing; the last interval may be open.

A capture meets the entries whose value is one of its keys - the page, the host, the host and each parent domain - and
whose interval holds its fetch time. The most specific entry decides: url, then host, then the longest domain; of equal
ones 'block'. Without an entry a capture is not blocked.

Scale. The join is an equality on (kind, value) with the time as a further condition: captures are never compared with
entries of other hosts. A capture has at most as many keys as its host has labels, and two. Catalyst broadcasts the intervals
only below its size limit, and splits skewed partitions of a host with very many captures otherwise. Repeated captures are
judged once; the decision is a maximum over a capture's matches, pre-aggregated before its shuffle.

Defined results. Null or malformed URL (no scheme or host): no keys, not blocked, host null. Null fetch time: no entry is
active. Null fields in an event: the event is ignored. Repeated captures give one row each, with equal verdicts. No events:
nothing is blocked. Long URLs are compared whole. Other columns stay; those named as the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = {"url": 3, "host": 2, "domain": 1}


def host(url: Column) -> Column:
    """The lower-cased host without port, user or final dot; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    found = F.regexp_replace(found, r"\.+$", "")
    return F.when(found != "", found)


def page(url: Column) -> Column:
    """Host, path and query: without scheme, user, port, fragment and final slash. Null without a host."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(host(url).isNotNull(), F.concat(host(url), F.regexp_replace(rest, r"/$", "")))


def intervals(events: DataFrame) -> DataFrame:
    """(list, kind, value, from, to), ``to`` null while the entry is still active."""
    known = F.col("list").isin("block", "allow") & F.col("kind").isin(*RANK) & F.col("action").isin("add", "remove") & F.col("value").isNotNull() & F.col("at").isNotNull()
    entry = Window.partitionBy("list", "kind", "value").orderBy("at", F.col("action") == "add")
    turns = (
        events.where(known)
        .select("list", "kind", F.lower("value").alias("value"), "action", "at")
        .withColumn("before", F.lag("action", 1, "remove").over(entry))
        .where("action <> before")
    )
    return turns.withColumn("to", F.lead("at").over(entry)).where("action = 'add'").select("list", "kind", "value", F.col("at").alias("from"), "to").where("to is null or from < to")


def keys(url: Column) -> Column:
    """Array of (kind, value) of a URL."""
    name = host(url)
    labels = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    own = F.array(F.struct(F.lit("url").alias("kind"), F.lower(page(url)).alias("value")), F.struct(F.lit("host").alias("kind"), name.alias("value")))
    return F.when(name.isNotNull(), F.concat(own, parents))


ADDED = ("host", "blocked", "list", "kind", "value")


def judge(captures: DataFrame, events: DataFrame) -> DataFrame:
    """The captures (url, fetched, and any other columns) with host, blocked, and the deciding entry: list, kind, value."""
    rest = [F.col(f"`{c}`") for c in captures.columns if c not in ADDED]
    rows = captures.select(F.struct(*rest).alias("row"), F.col("url").alias("page_url"), F.col("fetched").alias("time"))
    once = rows.select("page_url", "time").distinct()
    meets = once.withColumn("key", F.explode(keys(F.col("page_url")))).select("page_url", "time", F.col("key.kind").alias("kind"), F.col("key.value").alias("value"))
    joined = meets.join(intervals(events), ["kind", "value"]).where((F.col("from") <= F.col("time")) & (F.col("to").isNull() | (F.col("time") < F.col("to"))))
    rank = F.expr("case kind " + " ".join(f"when '{k}' then {v}" for k, v in RANK.items()) + " end")
    entry = F.struct(rank.alias("rank"), F.length("value").alias("size"), (F.col("list") == "block").alias("block"), F.col("list"), F.col("kind"), F.col("value"))
    verdicts = joined.groupBy("page_url", "time").agg(F.max(entry).alias("best"))
    judged = rows.join(verdicts, ["page_url", "time"], "left")
    return judged.select(
        *[F.col("row")[c].alias(c) for c in captures.columns if c not in ADDED],
        host(F.col("page_url")).alias("host"),
        F.coalesce("best.block", F.lit(False)).alias("blocked"),
        *[F.col("best")[c].alias(c) for c in ("list", "kind", "value")],
    )
