"""URL filters: a sort-merge range join of urls with host/path rules.

A host is keyed by its labels in reverse order, each followed by a dot, so a
host and all its subdomains fill one interval of keys. The bounds of all rule
intervals form a laminar family; between two neighbouring bounds the stack of
active nested rules is constant. A sorted sweep over bounds and urls together
hands every url the stack at its position; the longest rule whose path starts
the url's path decides.

Only DataFrame functions run. The sweep is cut at the hosts' last two labels: a
range of keys holds its own urls and bounds, and one bound for the rules of its
last label alone. A range with more than an even share of the urls is dealt to
lanes by row hash, and only its bounds are copied, so neither a hot host nor a
long list of rules grows with the number of lanes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a dot: a.b.c gives c.b.a. (dot at the end)."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def key_range(key: Column) -> Column:
    """The last two labels of a host, from its key: the part of the sweep that it belongs to."""
    return F.substring_index(key, ".", 2)


def _bounds(rules: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range, key, stack): the rules active from this key up to the range's next bound, for the given ranges."""
    rules = rules.select(
        F.translate(F.col("host"), _UPPER, _LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.col("verdict").cast("string").alias("verdict"),
    ).where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
    text = F.concat("host", "path")
    own = rules.groupBy("host").agg(F.collect_set(F.struct(F.length(text).alias("size"), text.alias("rule"), "path", "verdict")).alias("stack"))
    labels = F.split("host", r"\.")
    inside = own.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up", "ancestor"))
    held = inside.join(own.select(F.col("host").alias("ancestor"), "stack"), "ancestor")
    stacks = held.groupBy("host").agg(
        F.flatten(F.collect_list("stack")).alias("opened"),
        F.flatten(F.collect_list(F.when(F.col("up") > 0, F.col("stack")))).alias("closed"),
    )
    key = host_key(F.col("host"))
    opens = stacks.select(key.alias("key"), F.col("opened").alias("stack"))
    closes = stacks.select(F.concat(F.regexp_replace(key, r"\.$", ""), F.lit("/")).alias("key"), F.col("closed").alias("stack"))
    narrow = opens.unionByName(closes).withColumn("range", F.substring_index(F.regexp_replace("key", "/$", "."), ".", 2)).where(F.instr(F.col("range"), ".") < F.length("range"))
    broad = own.where(F.instr("host", ".") == 0).select(F.col("host").alias("last"), "stack")
    first = ranges.select("range", F.substring_index("range", ".", 1).alias("last")).join(broad, "last").select("range", F.concat("last", F.lit(".")).alias("key"), "stack")
    return narrow.join(ranges.select("range"), "range", "left_semi").select("range", "key", "stack").unionByName(first)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", lanes: int | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule (the longest that fits, else null), verdict.

    rules has host, path and verdict; the longest rule text wins, then the
    greater text, then ``block`` over ``allow``. A url that is null or has no
    ``://`` has empty host and path and the default verdict, as has any url
    that no rule fits. Repeated rows stay; other columns are ignored, whatever
    their names; empty tables give empty results (empty rules: all default). Should
    id_col bear the name of a result column, that column is prefixed ``url_``.
    A range of the sweep is split where it has more than 1 of lanes shares of
    the urls; at most lanes ranges have, so their table is safe to broadcast.
    """
    spark = pages.sparkSession
    lanes = lanes or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(f"`{url_col}`")
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(url_host(url), F.lit("")).alias("host"), F.coalesce(url_path(url), F.lit("")).alias("path"), F.coalesce(url, F.lit("")).alias("u"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("range", key_range(F.col("key")))
    ranges = urls.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    split = ranges.crossJoin(F.broadcast(urls.agg(F.count(F.lit(1)).alias("total")))).withColumn("parts", F.ceil(F.col("n") * lanes / F.col("total")).cast("int")).where("parts > 1").select("range", "parts")
    parts = F.coalesce("parts", F.lit(1))
    urls = urls.join(F.broadcast(split), "range", "left").select("id", "host", "path", "key", "range", F.pmod(F.xxhash64("id", "u"), parts).cast("int").alias("lane"))
    bounds = _bounds(rules, ranges).join(F.broadcast(split), "range", "left").select("range", "key", "stack", F.explode(F.sequence(F.lit(0), parts - 1)).alias("lane"))
    events = urls.withColumn("is_url", F.lit(1)).unionByName(bounds.withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("range", "lane").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    fits = F.array_max(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])))
    own = lambda name: f"url_{name}" if name == id_col else name
    return swept.withColumn("hit", fits).select(
        F.col("id").alias(id_col), F.col("host").alias(own("host")), F.col("path").alias(own("path")), F.col("hit.rule").alias(own("rule")), F.coalesce("hit.verdict", F.lit(default)).alias(own("verdict"))
    )
