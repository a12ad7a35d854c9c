"""URL filtering as a sort-merge range join, in DataFrame functions only.

A host is turned into a canonical key by reversing its labels and closing each
with a dot (``a.example.net`` is ``net.example.a.``), so a rule's host and all its
subdomains are one interval of keys.  Rules and urls are sorted together by key and
swept once.  The stack of open nested rules has one slot for each depth (number of
labels): a rule that begins overwrites the slot of its depth, and a slot whose key is
no prefix of the url's key belongs to a rule that has ended.  The same sweep then runs
over the paths below each open host, with a slot for each length of a rule's path.

The sweep is dealt out by a salt of the row and every salt gets all the rules' keys,
so a host with a third of all rows is spread like any other, and no task has to hold
the rules in memory: they are sorted, and spilled, like the other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, partitions

#: Salts for each shuffle partition; several even out what hashing deals to a partition.
SALTS_PER_PARTITION = 4


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _open_at(slots: list[int], is_rule: Column, slot: Column, value: Column, order: list[Column], fits) -> Column:
    """The values of the rules open at each row of a sweep in ``order``, shortest slot first.

    Two rules of one slot never nest, so the last one at or before a row is the only
    one of its slot that can still be open there; ``fits`` tells whether it is.
    """
    sweep = Window.partitionBy("salt").orderBy(*order, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = [F.last(F.when(is_rule & (slot == s), value), ignorenulls=True).over(sweep) for s in slots]
    return F.filter(F.array(*stack), lambda x: x.isNotNull() & F.coalesce(fits(x), F.lit(False)))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` has host, path and verdict (``allow`` or ``block``).  A rule fits its
    host and every subdomain if the url's path starts with the rule's.  The longest
    rule (host and path together) wins; of two as long, the one with the longer host;
    of two on the same host and path, ``block``.  ``rule`` is host and path as one
    string, or null where none fits; the verdict is then ``default``.

    A null or empty url, or one without ``://``, has an empty host and path.  Repeated
    rows and null ids stay as they are; other columns of ``pages`` are ignored.  Rules
    with a null host, path or verdict are ignored, and without rules all rows get
    ``default``.
    """
    spark = pages.sparkSession
    salts = SALTS_PER_PARTITION * partitions(spark)
    rules = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumns({"depth": F.size(F.split("rule_host", r"\.", -1)), "length": F.length("rule_path")})
    )
    judged = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    # The slots: how many labels hosts of rules have, and how long paths of rules are. Both are few numbers.
    shapes = rules.agg(F.sort_array(F.collect_set("depth")), F.sort_array(F.collect_set("length"))).first()
    depths, lengths = list(shapes[0] or []), list(shapes[1] or [])
    if not depths:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # Dealt by the place in the input, so that copies of one url are spread as well.
    points = judged.select("*", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(salts)).cast("int").alias("salt"), host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"))
    salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    by_host = rules.select("rule_host", "depth").distinct().select("*", host_key(F.col("rule_host")).alias("key"), F.lit(0).alias("kind"), salted)
    by_path = rules.select("*", F.lit(1).alias("kind"), salted)
    rows = points.unionByName(by_host, allowMissingColumns=True).unionByName(by_path, allowMissingColumns=True)
    rows = rows.repartition(partitions(spark), "salt")

    fits_host = lambda x: F.col("key").startswith(x["key"])
    hosts = _open_at(depths, F.col("kind") == 0, F.col("depth"), F.struct("key", "rule_host", "depth"), [F.col("key")], fits_host)
    rows = rows.withColumn("hosts", F.when(F.col("kind") == 2, hosts))
    found = []
    for i, depth in enumerate(depths):
        # The rules of this depth's hosts and the points below such a host, by host and then path.
        at = f"host_{i}"
        rows = rows.withColumn(at, F.when(F.col("kind") == 2, F.try_element_at(F.filter("hosts", lambda x: x["depth"] == depth), F.lit(1))["rule_host"]).when((F.col("kind") == 1) & (F.col("depth") == depth), F.col("rule_host")))
        where = F.coalesce("path", "rule_path")
        fits_path = lambda x, at=at: (x["rule_host"] == F.col(at)) & F.col("path").startswith(x["rule_path"])
        opened = _open_at(lengths, (F.col("kind") == 1) & (F.col("depth") == depth), F.col("length"), F.struct("rule_host", "rule_path", "rule_verdict"), [F.col(at), where], fits_path)
        rows = rows.withColumn(f"found_{i}", F.when(F.col("kind") == 2, opened))
        found.append(f"found_{i}")
    size = lambda x: (F.length(x["rule_host"]) + F.length(x["rule_path"])).alias("size")
    ranked = F.transform(F.concat(*found), lambda x: F.struct(size(x), F.length(x["rule_host"]).alias("host_size"), x["rule_host"].alias("rule_host"), x["rule_path"].alias("rule_path"), x["rule_verdict"].alias("rule_verdict")))
    best = rows.where("kind = 2").withColumn("best", F.array_max(ranked))
    return best.select("page_id", "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
