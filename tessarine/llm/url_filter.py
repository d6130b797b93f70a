"""Operator 7: URL filters as a temporal join, with DataFrame functions only.

Dated list entries become validity intervals: an entry holds until the next one of the same list and pattern. Every capture is matched, by
the domains and path prefixes of its URL, with the intervals that hold when it was fetched. Both sides meet in an equi-join on the
pattern, which the adaptive planner splits where a host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import free_name, numbered


def address(url: Column) -> Column:
    """Host and path in one form: no scheme, user, www., port, query, fragment or end slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(bare, "/", 1)), r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"^[^/]*", ""), r"/+$", "")
    return F.concat(host, path)


def patterns(url: Column) -> Column:
    """What an entry may say to match a URL: each domain of two labels or more that the host lies in, and the address cut at each slash."""
    full = address(url)
    host, parts = F.substring_index(full, "/", 1), F.split(full, "/")
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.filter(F.array_distinct(F.concat(domains, paths)), lambda p: p != "")


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (null: still) of entries (list, pattern, dated, listed boolean).

    Of entries of one list, pattern and date, one that takes off the list wins; null patterns and dates are left out; equal entries count once.
    """
    e = entries.where("pattern is not null and dated is not null").groupBy("list", "pattern", "dated").agg(F.min(F.coalesce("listed", F.lit(True))).alias("listed"))
    w = W.Window.partitionBy("list", "pattern").orderBy("dated")
    return e.withColumn("valid_to", F.lead("dated").over(w)).where("listed").select("list", "pattern", F.col("dated").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """A row for each capture: its id, blocked, n_entries (active entries that match), rule (the longest of their patterns, the least of equals), lists.

    Null or empty URLs and null times match nothing. Repeated captures and ids keep their rows. Entries have list, pattern, dated, listed;
    see intervals(). No list or no captures: nothing is blocked, or no rows.
    """
    (row,) = free_name(captures, "_row")
    cap = captures.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(time_col).alias("_at"))
    cap = numbered(cap, row, F.xxhash64("_id", "_url", "_at"))
    keys = cap.select(row, "_id", "_at", F.explode_outer(patterns(F.col("_url"))).alias("_key"))
    iv = intervals(entries)
    hit = keys.join(iv, (F.col("_key") == iv["pattern"]) & (F.col("_at") >= iv["valid_from"]) & (iv["valid_to"].isNull() | (F.col("_at") < iv["valid_to"])), "left")
    best = F.min(F.when(F.col("pattern").isNotNull(), F.struct(-F.length("pattern"), F.col("pattern").alias("p"))))
    return hit.groupBy(row, "_id").agg(F.count("pattern").alias("n_entries"), best["p"].alias("rule"), F.array_sort(F.collect_set("list")).alias("lists")).select(F.col("_id").alias(id_col), (F.col("n_entries") > 0).alias("blocked"), "n_entries", "rule", "lists")
