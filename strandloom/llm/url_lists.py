"""Filter captures by dated URL lists, with a temporal join.

A list entry says from which day on a domain is blocked or allowed.  The
entries of a domain become validity intervals: each holds until the next one begins.  A capture is
judged by the entry that was active on the day it was fetched, for its host or the
nearest parent domain that has one.

The as-of join runs on distinct (host, day) pairs, so a host with very many
captures costs no more than its days.  Intervals are cut by month, and the
join is an equi-join on domain and month, so a domain that all hosts
share is spread over its months.

Captures without a host or day, or without an active entry, are not blocked.  Entries without a
domain or day are left out.  Of several entries for a domain on one day, blocking wins.
Repeated captures give repeated rows; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url: Column) -> Column:
    """Lower-case host of a URL without port and final dot; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), r"\.$", "")
    return F.when(found != "", found)


def parents(name: Column) -> Column:
    """A host and all its parent domains, longest first."""
    parts = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


def intervals(entries: DataFrame, domain: str = "domain", day: str = "day", action: str = "action") -> DataFrame:
    """(domain, action, valid_from, valid_to): valid_to is the day before which it ends, null if it never does."""
    daily = (
        entries.select(F.lower(F.trim(F.col(domain))).alias("domain"), F.col(day).alias("valid_from"),
                       F.col(action).alias("action"))
        .where("domain IS NOT NULL AND domain <> '' AND valid_from IS NOT NULL AND action IS NOT NULL")
        .groupBy("domain", "valid_from").agg(F.max("action").alias("action"))  # 'block' after 'allow'
    )
    order = Window.partitionBy("domain").orderBy("valid_from")  # at most one row a day
    return daily.withColumn("valid_to", F.lead("valid_from").over(order))


def verdicts(requests: DataFrame, valid: DataFrame) -> DataFrame:
    """(host, day, domain, action) of distinct (host, day) rows that have an active entry."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    asked = requests.select("host", "day", F.posexplode(parents(F.col("host"))).alias("up", "domain")).withColumn(
        "month", month("day")
    )
    latest = requests.agg(F.max("day").alias("d")).first()["d"]
    if latest is None:
        latest = "1970-01-01"
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(latest).cast("date")), F.lit(latest).cast("date"))
    cut = valid.where(F.col("valid_from") <= end).withColumn(
        "month", F.explode(F.sequence(month("valid_from"), month(end)))
    )
    active = asked.join(cut, ["domain", "month"]).where(
        (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    )
    best = active.groupBy("host", "day").agg(F.min("up").alias("up"))
    return active.join(best, ["host", "day", "up"]).select("host", "day", "domain", "action")


def judge(
    captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day"
) -> DataFrame:
    """(id, host, day, listed_domain, listed_action, blocked) of every capture."""
    asked = captures.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), F.col(day_col).alias("day"))
    requests = asked.where("host IS NOT NULL AND day IS NOT NULL").groupBy("host", "day").agg(F.lit(1).alias("_one"))
    found = verdicts(requests.select("host", "day"), intervals(entries))
    return asked.join(found, ["host", "day"], "left").select(
        F.col("id").alias(id_col), "host", "day", F.col("domain").alias("listed_domain"),
        F.col("action").alias("listed_action"), (F.coalesce("action", F.lit("")) == "block").alias("blocked"),
    )
