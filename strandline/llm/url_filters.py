"""URL allow and block rules by a sort-merge sweep over reversed-host keys.

A host is written with its labels reversed and each followed by a comma, so that
``example.com`` becomes ``com,example,``. The hosts that a rule covers are then
exactly the keys with its own key as a prefix: an interval of the sort order, and
any two intervals are nested or disjoint. A sweep in key order therefore needs only
the stack of the rules that were open when the last rule began. Two sweeps follow
each other, one over distinct hosts and one over the paths of each rule's host.

Everything is DataFrame operations. Hosts and rules meet by their domain (the first two
labels), so a rule goes where its domain has hosts and nowhere else; a rule of one label
goes to the domains below it. A domain or a rule's host with more than ``lane_rows`` rows
is dealt to lanes, and only its rules are copied to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import join_hot, materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a comma."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(","))


def _stacks(rules: DataFrame, part: list[str], key: str) -> DataFrame:
    """For each distinct ``(part, key)`` the keys of that part that are prefixes of it, outermost first.

    Every prefix of the key is looked up with an equi-join, so the work is a rule's length.
    """
    keys = rules.select(*part, key).distinct()
    prefixes = keys.withColumn("_open", F.explode(F.transform(F.sequence(F.lit(0), F.length(key)), lambda n: F.substring(F.col(key), F.lit(1), n))))
    known = keys.withColumnRenamed(key, "_open")
    found = prefixes.join(known, [*part, "_open"])
    return found.groupBy(*part, key).agg(F.array_sort(F.collect_list("_open")).alias("_stack"))


def domain_of(key: Column) -> Column:
    """The first two labels of a host key, or the one it has."""
    return F.regexp_extract(key, r"(?s)\A[^,]*,(?:[^,]*,)?", 0)


def _lanes(rows: DataFrame, part: str, lane_rows: int, most: int = 1_000_000) -> DataFrame:
    """part and its number of lanes, for parts that need more than one; marked for broadcast if there are at most ``most`` of them."""
    hot = rows.groupBy(part).agg(F.ceil(F.count("*") / lane_rows).cast("int").alias("_lanes")).where("_lanes > 1")
    hot = materialise(hot, "hot-hosts")
    return F.broadcast(hot) if hot.limit(most + 1).count() <= most else hot


def _sweep(rows: DataFrame, stacks: DataFrame, part: str, key: str, ids: list[str], lane_rows: int) -> DataFrame:
    """Add ``_stack`` to each row: the rule keys of its part that are prefixes of its key.

    stacks: part, key, _stack. Rows are dealt to the lanes of their part by ``ids``.
    """
    lanes = _lanes(rows, part, lane_rows)
    rest = [c for c in rows.columns if c not in (part, key)]
    n = F.coalesce("_lanes", F.lit(1))
    opened = stacks.join(lanes, part, "left").select(part, key, F.lit(0).alias("_event"), "_stack", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest), F.explode(F.sequence(F.lit(0), n - 1)).alias("_lane"))
    lane = F.pmod(F.xxhash64(*ids), n).cast("int").alias("_lane")
    seen = rows.join(lanes, part, "left").select(part, key, F.lit(1).alias("_event"), F.lit(None).cast("array<string>").alias("_stack"), *rest, lane)
    swept = W.partitionBy(part, "_lane").orderBy(key, "_event").rowsBetween(W.unboundedPreceding, 0)
    last = F.last("_stack", ignorenulls=True).over(swept)
    held = F.filter(F.coalesce("_last", F.array().cast("array<string>")), lambda k: F.col(key).startswith(k))
    return opened.unionByName(seen).withColumn("_last", last).where("_event = 1").withColumn("_stack", held).drop("_last", "_event", "_lane")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url", lane_rows: int = 100_000) -> DataFrame:
    """Judge each url by the longest rule that fits it.

    ``rules``: host, path, verdict. A rule fits its host and all its subdomains if the
    url's path starts with its path. The longest host and path together wins, then the
    longest host; equal rules give the smallest verdict.

    Returns one row per row of ``pages``: the id column, host, path, rule (null if none
    fits) and verdict. A null url, or one without ``://``, has an empty host and path and
    gets ``default``. Repeated rows stay repeated, other columns of ``pages`` are ignored
    whatever their names, null ids are kept, urls of any length are taken whole, and empty
    tables give an empty result or only defaults.
    """
    known = rules.select(host_key(F.coalesce("host", F.lit(""))).alias("hkey"), F.coalesce("path", F.lit("")).alias("pkey"), F.col("host").alias("rhost"), "verdict").groupBy("hkey", "pkey").agg(F.min("rhost").alias("rhost"), F.min("verdict").alias("verdict"))

    urls = pages.select(F.col(id_column).alias("_id"), F.col(url_column).alias("_url"), F.monotonically_increasing_id().alias("_rid"))
    urls = urls.select("_rid", "_id", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path")).withColumn("hkey", host_key(F.col("_host")))
    urls = materialise(urls, "urls")
    hosts = materialise(urls.groupBy("hkey").agg(F.count("*").alias("_urls")).withColumn("_part", domain_of(F.col("hkey"))), "hosts")

    # Each rule's host with the domains that have hosts and that it may cover.
    parts = hosts.select("_part").distinct()
    open_hosts = _stacks(known, [], "hkey").withColumn("_part", domain_of(F.col("hkey")))
    one_label = F.col("hkey").rlike(r"(?s)\A[^,]*,\z")
    tops = parts.withColumn("hkey", F.regexp_extract("_part", r"(?s)\A[^,]*,", 0))
    at_domains = open_hosts.where(~one_label).join(parts, "_part", "left_semi").unionByName(open_hosts.where(one_label).drop("_part").join(tops, "hkey").select("hkey", "_stack", "_part"))
    by_host = _sweep(hosts, at_domains, "_part", "hkey", ["hkey"], lane_rows)
    covered = by_host.where(F.size("_stack") > 0).select(F.col("hkey").alias("_own"), "_urls", F.explode("_stack").alias("hkey"))
    covered = materialise(covered, "covered-hosts")

    met = join_hot(urls.select("_rid", F.col("hkey").alias("_own"), F.col("_path").alias("pkey")), covered, ["_own"], "_urls").drop("_own")
    by_path = _sweep(met, _stacks(known, ["hkey"], "pkey"), "hkey", "pkey", ["_rid"], lane_rows)
    fits = by_path.where(F.size("_stack") > 0).select("_rid", "hkey", F.element_at("_stack", -1).alias("pkey")).join(known, ["hkey", "pkey"])
    best = F.max(F.struct((F.length("rhost") + F.length("pkey")).alias("n"), F.length("rhost").alias("h"), F.concat("rhost", "pkey").alias("rule"), "verdict")).alias("best")
    judged = urls.join(fits.groupBy("_rid").agg(best), "_rid", "left")
    return judged.select(F.col("_id").alias(id_column), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
