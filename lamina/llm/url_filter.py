"""Temporal URL filter: dated list entries become validity intervals, captures are judged as of their fetch.

Everything is a built-in Spark expression. A capture is judged by its host and every parent domain of it. The
distinct (host, time) pairs are judged once, so a host with a third of all captures is one row a moment
before the join, and the decisions return to the captures by an ordinary equi-join.

Defined cases: a null or unreadable URL, a host of more than 253 characters and a null fetch time are never
blocked; entries without domain, action or date are ignored, repeated ones count once; of an ``add`` and a
``remove`` of one domain at one moment the ``remove`` counts; an interval begins with its entry and ends just
before the next; of several blocking domains the longest is named; repeated captures are judged one by one;
other columns of the captures pass through, the four result columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest host name of the domain name system.
MAX_HOST = 253
RESULT = ("blocked", "blocked_domain", "blocked_since", "blocked_until")


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and closing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*+://(?:[^/?#@]*+@)?+([^/:?#]+)", 1)
    host = F.rtrim(host, F.lit("."))
    return F.when(F.length(host).between(1, MAX_HOST), host)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to): when each domain is listed; ``valid_to`` is open and null at the end."""
    clean = (entries.where(F.col("domain").isNotNull() & F.col("action").isin("add", "remove") & F.col("dated").isNotNull())
             .select(F.lower("domain").alias("domain"), "action", "dated"))
    # One state a moment: remove sorts after add.
    states = clean.groupBy("domain", "dated").agg(F.max("action").alias("action"))
    line = Window.partitionBy("domain").orderBy("dated")
    return (states.withColumn("valid_to", F.lead("dated").over(line)).where(F.col("action") == "add")
            .select("domain", F.col("dated").alias("valid_from"), "valid_to"))


def judge(captures: DataFrame, listed: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Add ``blocked`` and the deciding interval to every capture; ``listed`` comes from :func:`intervals`."""
    known = captures.drop(*[c for c in RESULT if c in captures.columns])
    keyed = known.withColumn("_host", host_of(F.col(url))).withColumn("_time", F.col(fetched))
    moments = keyed.select("_host", "_time").where(F.col("_host").isNotNull() & F.col("_time").isNotNull()).distinct()
    labels = F.split("_host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = moments.select("_host", "_time", F.explode(parents).alias("domain"))
    active = (F.col("valid_from") <= F.col("_time")) & (F.col("valid_to").isNull() | (F.col("_time") < F.col("valid_to")))
    hits = asked.join(listed, "domain").where(active)
    longest = F.max_by(F.struct("domain", "valid_from", "valid_to"), F.length("domain"))
    decided = hits.groupBy("_host", "_time").agg(longest.alias("_hit"))
    return (keyed.join(decided, ["_host", "_time"], "left")
            .withColumn("blocked", F.col("_hit").isNotNull())
            .withColumn("blocked_domain", F.col("_hit.domain"))
            .withColumn("blocked_since", F.col("_hit.valid_from"))
            .withColumn("blocked_until", F.col("_hit.valid_to")).drop("_host", "_time", "_hit"))
