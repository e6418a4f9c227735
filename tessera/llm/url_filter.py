"""URL filter: dated list entries become validity intervals, and captures are joined to those active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; the empty text where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)
    return F.regexp_replace(F.lower(authority), r"\.+$", "")


def path_of(url: Column) -> Column:
    """The path without query, fragment and slashes at its ends."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")


def keys_of(host: Column, path: Column) -> Column:
    """What a list may hold against a URL: the host, each domain above it, and the host with each leading part of the path."""
    labels, parts = F.split(host, r"\."), F.split(path, "/+")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).when(path == "", domains).otherwise(F.concat(domains, prefixes))


def validity(entries: DataFrame, key: str, action: str, at: str) -> DataFrame:
    """Intervals (_key, _from, _to) in which a key is listed: from an 'add' to the next entry of the key; _to is open.

    Of entries of one key and time a 'remove' is the last. Entries with a null are left out, repeated ones count once.
    """
    rows = entries.select(F.lower(key).alias("_key"), F.lower(action).alias("_action"), F.col(at).alias("_from")).na.drop().distinct()
    following = F.lead("_from").over(Window.partitionBy("_key").orderBy("_from", "_action"))
    return rows.withColumn("_to", following).filter((F.col("_action") == "add") & (F.col("_to").isNull() | (F.col("_to") > F.col("_from")))).drop("_action")


def filter_urls(
    captures: DataFrame,
    entries: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    time_col: str = "fetched_at",
    key_col: str = "key",
    action_col: str = "action",
    at_col: str = "at",
) -> DataFrame:
    """Evaluate captures against the list as it was at their fetch time.

    entries: a key (a domain, which covers its subdomains, or a host with leading parts of a path), an action ('add' or
    'remove') and its time. Returns one row per capture: id_col, url_col, host, time_col, blocked, n_entries (keys
    active at fetch time that match), matched_key (the longest, then the first in order), listed_since. A null url has no
    host and is never blocked, nor is a capture without a time. Rows that repeat are evaluated each; ids may be null. An
    empty table of captures gives no rows, an empty list blocks nothing. Other columns are ignored, whatever their names.

    Only ids, times and keys are shuffled. Both sides of the join are plain exchanges, so a key that a third of all
    captures share is split among tasks; each capture meets at most one interval of a key.
    """
    rows = cut(
        captures.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(time_col).alias("_time"))
        .withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url")), "_row": F.monotonically_increasing_id()})
    )
    asked = rows.filter(F.col("_time").isNotNull()).select("_row", "_time", F.explode(keys_of(F.col("_host"), F.col("_path"))).alias("_key"))
    active = (F.col("_time") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_time") < F.col("_to")))
    hits = (
        asked.join(cut(validity(entries, key_col, action_col, at_col)), "_key")
        .filter(active)
        .groupBy("_row")
        .agg(F.count("*").alias("_n"), F.min(F.struct((-F.length("_key")).alias("l"), F.col("_key").alias("k"), F.col("_from").alias("f"))).alias("_hit"))
    )
    return rows.join(hits, "_row", "left").select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        F.col("_host").alias("host"),
        F.col("_time").alias(time_col),
        F.col("_n").isNotNull().alias("blocked"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("n_entries"),
        F.col("_hit.k").alias("matched_key"),
        F.col("_hit.f").alias("listed_since"),
    )
