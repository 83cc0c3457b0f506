"""URL filters by a temporal list join, with DataFrame functions only.

A list has dated entries (key, action, since): action ``block`` or ``allow``, or ``lift`` to end either. Entries of a
key become validity intervals [since, next since); a capture is judged by the entries that are valid when it was
fetched. Keys are domains, which match themselves and what is below them, or ``host/segment``, which match the host's
URLs with that first path segment. Of several valid keys the most specific decides: a path before a domain, more labels
before fewer.

Defined results: a URL that is null, empty or without a host, and a capture without a fetch time, has verdict ``none``;
entries with a null key, action or date are no entries; of entries of one key and date the last action in the order
allow, block, lift holds; repeated captures are judged each; other columns are ignored; an empty list gives ``none``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sensegauge.llm.shared import cut, few

#: Intervals that are broadcast at most.
FEW_INTERVALS = 200_000
#: A longer list is joined by key and salt, so that a key that a third of all captures have is spread.
SALTS = 16

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, since, until (null: open): disjoint for each key."""
    dated = entries.select(F.lower("key").alias("key"), "action", "since").dropna().groupBy("key", "since").agg(F.max("action").alias("action"))
    until = F.lead("since").over(W.Window.partitionBy("key").orderBy("since"))
    return dated.withColumn("until", until).where("action <> 'lift'").select("key", "action", "since", "until")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def keys(url: Column) -> Column:
    """The keys that match a URL, most specific first."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.concat(host(url), F.lit("/"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), SEGMENT, 1)))
    return F.when(host(url) != "", F.concat(F.array(path), domains))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, host, verdict (block, allow, none), rule, since for captures (page_id, url, fetched)."""
    spans = cut(intervals(entries))
    captures = captures.select("page_id", "url", "fetched")
    asked = captures.where("fetched is not null").select("page_id", "url", "fetched", F.posexplode(keys(F.col("url"))).alias("rank", "key"))
    if few(spans, FEW_INTERVALS):
        met = asked.join(F.broadcast(spans), "key")
    else:
        spread = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["key", "salt"])
    met = met.where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = met.groupBy("page_id", "url", "fetched").agg(F.min(F.struct("rank", "key", "action", "since")).alias("best"))
    best = best.select(*(F.col(c).alias(f"{c}_b") for c in ("page_id", "url", "fetched")), "best")
    same = F.col("page_id").eqNullSafe(F.col("page_id_b")) & F.col("url").eqNullSafe(F.col("url_b")) & F.col("fetched").eqNullSafe(F.col("fetched_b"))
    return captures.join(best, same, "left").select(
        "page_id", "url", "fetched", host(F.col("url")).alias("host"), F.coalesce("best.action", F.lit("none")).alias("verdict"),
        F.col("best.key").alias("rule"), F.col("best.since").alias("since"),
    )
