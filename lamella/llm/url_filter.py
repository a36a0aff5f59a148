"""Filter addresses by nested host and path rules with sorted sweeps."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Column, Window, functions as F


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or none: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; null or no host part: empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``a.b.net`` as ``net.b.a.``: all subdomains of a host share its key as a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _chains(rules: DataFrame, prefixes: Column, *payload: str) -> DataFrame:
    """For each rule key, the stack of rules whose keys are prefixes of it, itself included."""
    own = rules.select(F.col("key").alias("_own"), F.explode(prefixes).alias("key"))
    return own.join(rules, "key").groupBy(F.col("_own").alias("key")).agg(F.collect_list(F.struct("key", *payload)).alias("stack"))


def _sweep(rows: DataFrame, chains: DataFrame, salts: int) -> DataFrame:
    """Give each row the stack of rules that are open at its ``key``.

    Within a salt, rows and rules are in key order. The last rule passed carries the rules that
    enclose it; those that don't enclose the row have been closed since, and are popped.
    """
    spread = chains.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", F.lit(0).alias("turn"), "stack")
    both = rows.withColumn("turn", F.lit(1)).unionByName(spread, allowMissingColumns=True)
    order = Window.partitionBy("salt").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("turn = 1").drop("turn")
    return swept.withColumn("stack", F.filter(F.col("stack"), lambda r: F.startswith(F.col("key"), r["key"])))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", salts: int | None = None) -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the path starts with
    the rule's; the longest (host and path together, then the longer host) wins. Of rules for the
    same host and path, block wins; rules with a null are ignored; rules match in lower case.
    A row that no rule fits has a null rule and the verdict ``default``.

    Hosts become reversed keys, so that each rule is an interval of keys. One sorted sweep finds the
    stack of rule hosts open at each row, a second one the paths open under each of these. Rows are
    dealt by a hash of the address, not by host: a host with a third of all rows is spread. The rules
    are sent to each of ``salts`` sweeps (four for each shuffle partition), so they should be few
    beside the rows.

    Null and malformed urls: empty host and path, no rule. Repeated rows are judged one by one. An
    empty table gives no rows. Columns called host, path, rule or verdict are replaced; other columns
    are kept. Row order inside ``pages`` must be repeatable (files are).
    """
    salts = salts or 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rules = (
        rules.select(F.lower("host").alias("host"), F.col("path"), F.col("verdict"), F.concat("host", "path").alias("rule"))
        .dropna()
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"), F.min("rule").alias("rule"))
    )
    hosts = rules.select(host_key(F.col("host")).alias("key")).distinct()
    parts = F.split("key", r"\.")
    host_chains = _chains(hosts, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "."), F.lit("."))))
    paths = rules.select(F.concat(host_key(F.col("host")), "path").alias("key"), "rule", "verdict", F.length("host").alias("host_n"))
    path_chains = _chains(paths, F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), F.lit(1), i)), "rule", "verdict", "host_n")

    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = rows.select("*", host_key(F.col("host")).alias("key"), F.pmod(F.xxhash64("host", "path", "rid"), F.lit(salts)).cast("int").alias("salt"))
    open_hosts = _sweep(rows, host_chains, salts).select("salt", "rid", "row", "host", "path", F.explode_outer("stack.key").alias("above"))
    open_paths = _sweep(open_hosts.withColumn("key", F.concat(F.coalesce("above", F.lit("")), "path")).drop("above"), path_chains, salts)
    longest = F.array_max(F.transform(F.col("stack"), lambda r: F.struct(F.length(r["rule"]).alias("n"), r["host_n"].alias("host_n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    judged = open_paths.groupBy("salt", "rid").agg(F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(longest).alias("best"))
    return judged.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
