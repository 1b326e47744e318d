"""URL filters by a sort-merge range join with prefix rules.

A rule is a host and a path: it fits its host and all subdomains if the url's
path starts with the rule's. Keys are canonical: the labels of a host in reverse,
each ended by a dot, so that a rule's host is a prefix, that is, the interval from
the key up to the key followed by a byte no UTF-8 text holds.

Both sweeps work alike. Interval ends and urls are sorted together by range over
the whole cluster; what is open at an end is known from the rules alone (they are
nested), so each url takes what the last end before it left open, and a task gets
the last end before its range from one row per task. Sweep one gives each url the
stack of rule hosts that enclose its host. Sweep two runs over (rule host, path)
for each entry of that stack and gives the longest path rule there; the longest
rule of all wins (host and path characters; of equal ones the longer host).

Everything is DataFrame code. A host with very many urls is split, as the sort
goes on to path and row. Defined cases: a null url, or one without ``://``, has
empty host and path; no fitting rule: null and the default verdict; repeated rules
count once, and of contradicting ones ``block`` wins; null hosts or paths of rules
are empty texts; without rules every url gets the default; repeated urls get equal
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmeter.llm.common import ascii_lower
from hopmeter.session import cut

END = bytes([0xFF])


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot, as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def _prefix_chain(known: DataFrame, key: str, prefixes: Column) -> DataFrame:
    """(key, chain): for each key of ``known`` the known keys among its own prefixes, longest last."""
    pairs = known.select(F.col(key), F.explode(prefixes).alias("prefix"))
    return (
        pairs.join(known.select(F.col(key).alias("prefix")), "prefix")
        .groupBy(key)
        .agg(F.sort_array(F.collect_set("prefix")).alias("chain"))
    )


def sweep(points: DataFrame, ends: DataFrame) -> DataFrame:
    """``points`` with ``open``: what the last of ``ends`` at or before their ``k`` left open.

    ``points``: k (binary), row and more; ``ends``: k and open. Ends come before
    points of the same key.
    """
    extra = [c for c in points.columns if c not in ("k", "row")]
    kinds = dict(points.dtypes)
    events = points.withColumns({"is_point": F.lit(1), "open": F.lit(None).cast(dict(ends.dtypes)["open"])}).unionByName(
        ends.select(
            "k", "open", F.lit(0).alias("is_point"), F.lit(None).cast(kinds["row"]).alias("row"),
            *[F.lit(None).cast(kinds[c]).alias(c) for c in extra],
        )
    )
    order = ["k", "is_point", "row"]
    laid = cut(events.repartitionByRange(*order).withColumn("task", F.spark_partition_id()), "sweep")
    last = laid.filter("is_point = 0").groupBy("task").agg(F.max(F.struct("k", "open")).alias("end"))
    # One row per task from here to the join.
    tasks = laid.select("task").distinct().join(last, "task", "left")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carried = tasks.select("task", F.last("end", ignorenulls=True).over(before)["open"].alias("carried"))
    here = Window.partitionBy("task").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        laid.join(carried, "task", "left")
        .withColumn("open", F.coalesce(F.last("open", ignorenulls=True).over(here), "carried"))
        .filter("is_point = 1")
        .drop("is_point", "task", "carried")
    )


def _ends(chains: DataFrame, key: str) -> DataFrame:
    """Where an interval opens its whole chain is open, where it closes the chain without it."""
    opened = chains.select(F.col(key).alias("k"), F.col("chain").alias("open"))
    closed = chains.select(
        F.concat(F.col(key), F.lit(END)).alias("k"), F.slice("chain", 1, F.size("chain") - 1).alias("open")
    )
    # Intervals that end together: the outermost says what stays open.
    return opened.unionByName(closed).groupBy("k").agg(F.min_by("open", F.size("open")).alias("open"))


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule, verdict) of every row of ``urls`` (row, host, path) that a rule fits.

    ``rules``: host, path, verdict.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rules = cut(
        rules.select(text("host").alias("host"), text("path").alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("rule_host", host_key(F.col("host"))),
        "url-rules",
    )
    # Sweep one: rule hosts around each host.
    hosts = rules.select("rule_host").distinct()
    labels = F.split(F.col("rule_host").cast("string"), r"\.")
    shorter = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1),
        lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")).cast("binary"),
    )
    points = urls.select(host_key(F.col("host")).alias("k"), "row", "path")
    around = sweep(points, _ends(_prefix_chain(hosts, "rule_host", shorter), "rule_host"))
    # Sweep two: path rules of each of those hosts. The separator stands in no key.
    joined = lambda host, path: F.concat(host, F.lit(bytes([0xFE])), path.cast("binary"))
    paths = rules.withColumn("rule_key", joined(F.col("rule_host"), F.col("path")))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.length("path")),
        lambda n: joined(F.col("rule_host"), F.substring(F.col("path"), F.lit(1), n)),
    )
    chains = _prefix_chain(paths, "rule_key", prefixes)
    at = around.filter(F.size("open") > 0).select("row", "path", F.explode("open").alias("rule_host"))
    inner = sweep(
        at.select(joined(F.col("rule_host"), F.col("path")).alias("k"), "row"), _ends(chains, "rule_key")
    ).filter(F.size("open") > 0)
    fits = inner.select("row", F.element_at("open", -1).alias("rule_key")).join(
        paths.select(
            "rule_key", "verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars")
        ),
        "rule_key",
    )
    best = F.max(F.struct(F.length("rule").alias("n"), "host_chars", "rule", "verdict")).alias("best")
    return fits.groupBy("row").agg(best).select("row", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url)."""
    numbered = cut(
        pages.select(
            "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "urls-numbered",
    )
    found = longest_rules(numbered.select("row", "host", "path"), rules)
    return numbered.join(found, "row", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
