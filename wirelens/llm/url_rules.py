"""URL filters as a sort-merge range join over reversed-host keys.

A host becomes its labels in reverse, each followed by a dot
(``m.example.net`` is ``net.example.m.``), so a rule for a host and all its
subdomains is the interval of keys that begin with the rule's key, and
intervals either nest or are disjoint. A sweep over keys and interval starts in
sorted order needs only the last start at or before a key: the intervals open
there are that rule and the rules around it, its stack. The stack of every rule
is made once from the rules alone.

The sweep runs twice. First over the distinct hosts, which gives each host the
rule hosts around it; then over ``rule host key + path`` for each of these,
where a rule's path is an interval again. Rows with one host or URL, however
many, are swept once and get their result by an equi join.

Keys are dealt to ranges whose limits are interval starts, and every range is
spread by a hash of the key over ``SPREAD`` tasks; the starts of a range, few
beside the keys, go to each of them with the stack open at its beginning. So a
range that holds a third of the keys is no single task, and nothing is
broadcast or sorted in one place.

Rules are rows (host, path, verdict); a rule's path begins with ``/``. Of the
rules that fit a URL the longest string wins, then the one with the longer
host; of equal (host, path) rows, ``block`` wins. Defined results: a NULL URL or
one without ``://`` has an empty host and path and gets the default verdict;
rules with a NULL host or path are ignored; repeated rows and NULL ids are kept;
an empty table, of URLs or of rules, works; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelens.llm.frames import ascii_lower, columns

#: Ranges of keys, and tasks that share one range.
RANGES = 32
SPREAD = 16

DEFAULT_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def rules_frame(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://`` up to ``/?#``, then up to ``?#``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return (
        ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)),
        F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1),
    )


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _limits(starts: DataFrame) -> list[str]:
    """At most RANGES - 1 interval starts that split the starts evenly."""
    dealt = starts.repartitionByRange(RANGES, "key").groupBy(F.spark_partition_id().alias("p"))
    return sorted(r["k"] for r in dealt.agg(F.min("key").alias("k")).collect())[1:]


def _range_of(key: Column, limits: list[str]) -> Column:
    if not limits:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x <= key))


def stacks(starts: DataFrame) -> DataFrame:
    """key, stack: for each interval start the starts of all intervals open there, itself included.

    An interval around a start is one of its prefixes, so pairs come from an
    equi join of prefixes; a rule has as many as its key is long, and a stack is
    as deep as rules nest.
    """
    cuts = starts.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
    prefixes = cuts.select("key", F.expr("left(key, n)").alias("open"))
    inner = prefixes.join(starts.select(F.col("key").alias("open")), "open")
    return inner.groupBy("key").agg(F.sort_array(F.collect_set("open")).alias("stack"))


def sweep(keys: DataFrame, starts: DataFrame) -> DataFrame:
    """key, open: every interval start whose interval holds the key; keys in no interval are left out.

    ``keys`` and ``starts`` are distinct in their column ``key``.
    """
    limits = _limits(starts)
    marks = stacks(starts).select("key", "stack", _range_of(F.col("key"), limits).alias("r"))
    # what is open when a range begins: the stack of the last start before it
    last = marks.groupBy("r").agg(F.max(F.struct("key", "stack")).alias("m"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    every = last.sparkSession.range(len(limits) + 1).select(F.col("id").cast("int").alias("r"))
    carried = every.join(last, "r", "left").select("r", F.last("m", ignorenulls=True).over(before).alias("m"))
    begins = carried.filter("m IS NOT NULL").select(F.col("m.stack").alias("stack"), "r", F.lit(None).cast("string").alias("key"))
    events = marks.select("stack", "r", "key").unionByName(begins)
    copies = events.select(
        "key", "stack", "r", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("s"), F.lit(0).alias("is_key")
    )
    probes = keys.select(
        "key",
        F.lit(None).cast("array<string>").alias("stack"),
        _range_of(F.col("key"), limits).alias("r"),
        F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int").alias("s"),
        F.lit(1).alias("is_key"),
    )
    w = Window.partitionBy("r", "s").orderBy(F.col("key").asc_nulls_first(), "is_key")
    swept = probes.unionByName(copies).withColumn("stack", F.last("stack", ignorenulls=True).over(w))
    open_ = F.filter("stack", lambda x: F.col("key").startswith(x))
    return swept.filter("is_key = 1").select("key", F.explode(open_).alias("open"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule, verdict of every row of ``pages``."""
    rules = columns(rules, "host", "path", "verdict").filter("host IS NOT NULL AND path IS NOT NULL")
    ruled = rules.groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict"))["verdict"].alias("verdict"))
    ruled = ruled.withColumn("host_key", reversed_key(F.col("host"))).withColumn("key", F.concat("host_key", "path"))
    hosts_ruled = ruled.select(F.col("host_key").alias("key")).distinct()

    host, path = split_url(F.col("url"))
    rows = columns(pages, key, url).toDF("id", "url").select("id", host.alias("host"), path.alias("path"))
    urls = rows.filter("path <> ''").select("host", "path").distinct()
    hosts = urls.select("host").distinct().withColumn("key", reversed_key(F.col("host")))
    around = hosts.join(sweep(hosts.select("key"), hosts_ruled), "key").select("host", F.col("open").alias("host_key"))
    candidates = urls.join(around, "host").withColumn("key", F.concat("host_key", "path"))
    fits = sweep(candidates.select("key").distinct(), ruled.select("key")).withColumnRenamed("open", "rule_key")
    named = ruled.select(
        F.col("key").alias("rule_key"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_len")
    )
    best = (
        candidates.join(fits.join(named, "rule_key"), "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule"), "host_len", "rule", "verdict")).alias("m"))
        .select("host", "path", "m.rule", "m.verdict")
    )
    out = rows.join(best, ["host", "path"], "left")
    return out.select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
