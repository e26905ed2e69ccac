"""URL rules by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tamiz.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``: a host and its subdomains share a prefix."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, "\\."))), F.lit("."))


def sweep(keys: DataFrame, boundaries: DataFrame) -> DataFrame:
    """For each distinct ``key``, the ``open`` of the last boundary at or below it, else null.

    ``boundaries``: distinct ``key`` and a struct ``open``, what is active from there
    on. Both are sorted together into ranges; each range is swept once, and what was
    open when a range begins comes from a table with one row for each range. Keys
    are distinct, so no range can be filled by one of them.
    """
    kind = boundaries.schema["open"].dataType
    events = keys.select("key", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("open")).unionByName(
        boundaries.select("key", F.lit(0).alias("kind"), "open")
    )
    # Stored, so that a task that runs again finds the same ranges.
    ranged = materialize(events.repartitionByRange("key").withColumn("range", F.spark_partition_id()))
    so_far = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(
        ranged.groupBy("range")
        .agg(F.max_by("open", F.when(F.col("kind") == 0, F.col("key"))).alias("at_end"))
        .select("range", F.last("at_end", ignorenulls=True).over(ranges).alias("carried"))
    )
    return (
        ranged.withColumn("open", F.last("open", ignorenulls=True).over(so_far))
        .where("kind = 1")
        .join(carried, "range")
        .select("key", F.coalesce("open", "carried").alias("open"))
    )


def _suffixes(host: Column) -> Column:
    """The host itself and what is left after taking labels from its front."""
    labels = F.split(host, "\\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))
    )


def host_boundaries(rules: DataFrame) -> DataFrame:
    """Where the stack of active rule hosts changes, and the stack from there on.

    A host's interval begins at its key and ends at the same key with ``/`` for its
    last ``.``; intervals nest. At the beginning the stack is the rule hosts among
    the host and the domains above it, at the end those above it.
    """
    hosts = rules.select("host").distinct()
    above = (
        hosts.select(F.col("host").alias("inner"), F.explode(_suffixes(F.col("host"))).alias("host"))
        .join(hosts, "host")
        .groupBy("inner")
        .agg(F.array_sort(F.collect_set("host")).alias("hosts"))
    )
    key = host_key(F.col("inner"))
    begins = above.select(key.alias("key"), F.struct("hosts").alias("open"))
    ends = above.select(
        F.regexp_replace(key, "\\.$", "/").alias("key"),
        F.struct(F.array_except("hosts", F.array("inner")).alias("hosts")).alias("open"),
    )
    return begins.unionByName(ends)


def path_key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("/"), F.hex(F.encode(path, "UTF-8")))


def path_boundaries(rules: DataFrame) -> DataFrame:
    """Where the innermost path rule of a rule host changes; hexadecimal keys end before ``g``."""
    cuts = F.sequence(F.lit(0), F.length("path"))
    shorter = (
        rules.select("host", "path", F.explode(cuts).alias("cut"))
        .where(F.col("cut") < F.length("path"))
        .select("host", F.col("path").alias("inner"), F.expr("left(path, cut)").alias("path"))
        .join(rules, ["host", "path"])
        .groupBy("host", F.col("inner").alias("path"))
        .agg(F.max_by(F.struct("path", "verdict"), F.length("path")).alias("outer"))
    )
    key = path_key(F.col("host"), F.col("path"))
    begins = rules.select(key.alias("key"), F.struct(F.struct("path", "verdict").alias("rule")).alias("open"))
    ends = rules.join(shorter, ["host", "path"], "left").select(
        F.concat(key, F.lit("g")).alias("key"), F.struct(F.col("outer").alias("rule")).alias("open")
    )
    return begins.unionByName(ends)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge each ``url``: adds ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``verdict`` (allow or block), ``host`` and ``path``. A rule fits its
    host and all subdomains where the url's path begins with the rule's; the longest
    text of host and path wins, of equal ones that with the longer host. Of two
    verdicts for the same host and path, block holds. Without a fitting rule
    ``rule`` is null and ``verdict`` is ``default``.

    Two sweeps: hosts over the intervals of rule hosts give the stack of active rule
    hosts, as many as the host has labels at most; paths over the intervals of the
    rules of each stacked host give the innermost rule. Both run over distinct
    values, so repeated hosts and pages move once.

    A null url, or one without ``://``, has an empty host and path and no rule.
    Repeated pages keep a row each; empty tables stay empty; result columns replace
    columns of the same name.
    """
    rules = (
        rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .where("host is not null and host != ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    rules = materialize(rules)
    judged = pages.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))}).drop("rule", "verdict")

    pairs = materialize(judged.select("host", "path").distinct())
    hosts = pairs.select("host").distinct().withColumn("key", host_key(F.col("host")))
    stacks = hosts.join(sweep(hosts.select("key"), host_boundaries(rules)), "key").select(
        "host", F.col("open.hosts").alias("stack")
    )
    probes = materialize(
        pairs.join(stacks, "host").select("host", "path", F.explode("stack").alias("rule_host"))
        .withColumn("key", path_key(F.col("rule_host"), F.col("path")))
    )
    found = (
        probes.join(sweep(probes.select("key").distinct(), path_boundaries(rules)), "key")
        .where("open.rule is not null")
        .withColumn("rule", F.concat("rule_host", "open.rule.path"))
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct("rule", F.col("open.rule.verdict").alias("verdict")),
                F.struct(F.length("rule"), F.length("rule_host")),
            ).alias("best")
        )
    )
    found = materialize(found.select("host", "path", "best.rule", "best.verdict"))
    return judged.join(found, ["host", "path"], "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(default))
    )
