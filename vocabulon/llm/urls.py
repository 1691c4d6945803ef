"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a path; it fits that host and all its subdomains, where the URL's path
starts with the entry's.  Each URL gives the candidate keys host suffix + path prefix, only at label
counts and path lengths that occur in the list.  Candidates that miss the Bloom filter are dropped
inside the scan; the rest meet the list in an equi-join, which removes the filter's false hits, and
the longest fitting entry decides.  Everything is built of DataFrame functions.

Defined cases: a null URL or one without ``://`` has an empty host and path; entries with equal host
and path count once, ``block`` winning over ``allow``; of entries of one length the longer host
wins; list rows with a null or empty host, a null path or action are ignored; repeated pages each get
their row; a URL of any length is read whole; extra columns aren't looked at; empty tables give empty results, and an empty list gives every page the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .durable import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def verdicts(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for ``pages`` (page_id, url) and ``listed`` (host, path, action).

    ``rule`` is host + path of the longest fitting entry, else null with the verdict ``default``.
    """
    entries = (
        listed.where("host <> '' and path is not null and action is not null")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action")
        .groupBy("host", "path").agg(F.max("action").alias("action"))
        .select(F.concat("host", "path").alias("key"), "host", "path", "action")
    )
    facts = entries.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"),
        F.array_sort(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not facts["n"]:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    counts = "array(" + ",".join(str(x) for x in facts["labels"]) + ")"
    lengths = "array(" + ",".join(str(x) for x in facts["lengths"]) + ")"
    suffixes = f"transform(filter({counts}, n -> n <= size(split(host, '[.]'))), n -> substring_index(host, '.', -n))"
    prefixes = f"transform(filter({lengths}, n -> n <= length(path)), n -> substring(path, 1, n))"
    keys = F.explode(F.expr(f"flatten(transform({suffixes}, s -> transform({prefixes}, p -> concat(s, p))))")).alias("key")
    possible = bloom.filtered(parsed.select("host", "path", keys), "key", entries, "key", facts["n"]).distinct()
    rank = F.struct(F.length("key"), F.length("entry_host"), "key", "action")
    found = (
        possible.join(entries.select("key", F.col("host").alias("entry_host"), "action"), "key")
        .groupBy("host", "path").agg(F.max(rank).alias("best"))
        .select("host", "path", F.col("best.key").alias("rule"), F.col("best.action").alias("verdict"))
    )
    # written first, so both sides of the join are plain and a URL that very many pages share is split over tasks
    named = parsed.where("host <> ''").join(written(found, "verdicts"), ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    return named.unionByName(parsed.where("host = ''").select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
