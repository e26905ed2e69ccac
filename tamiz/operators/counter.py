"""Running counter within groups of equal keys, safe against hot groups.

Most groups hold one row, whose number is 1. Counting 64-bit hashes of the keys, a few
bytes per row, tells which groups may hold more; while these are few, only their rows
are shuffled. An ordinary group is then numbered by a plain ``row_number`` window. A
group that holds a large share of all rows would land in a single task, so it is cut
into ordered buckets of about ``hot_rows`` rows, numbered bucket by bucket, and moved
up by the rows of the earlier buckets. The numbers are the same on every path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tamiz.session import join_null_safe, materialize

HOT_ROWS = 1_000_000  # a group of this size still fits one task comfortably
FEW_GROUPS = 500_000  # beyond so many repeated groups all rows are numbered alike
CUTS = 16  # percentiles: the square of this many
COPY_CHUNK = 500_000

_HASH, _BITS, _ORDER, _BUCKET, _COPIES, _START, _CHUNK = (
    "__key_hash", "__bits", "__order", "__bucket", "__copies", "__start", "__chunk",
)


def repeated_groups(hashed: DataFrame) -> DataFrame:
    """(hash of the keys, rows) of every hash that occurs twice; combined map-side."""
    return hashed.groupBy(_HASH).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def hot_groups(repeated: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(hash, bits of its bucket number) of all groups to split; stored, its size decides the join."""
    buckets = F.floor(F.col("n") / hot_rows).cast("bigint")
    bits = F.greatest(F.lit(1), F.length(F.bin(buckets))).cast("int")
    return materialize(repeated.where(F.col("n") >= hot_rows).select(_HASH, bits.alias(_BITS)))


def group_counter(
    df: DataFrame,
    keys: list[str],
    name: str = "contador",
    position: str | None = None,
    hot_rows: int = HOT_ROWS,
    few_groups: int = FEW_GROUPS,
) -> DataFrame:
    """Add ``name``: 1, 2, 3 … within each group of equal ``keys`` (nulls are equal).

    ``position`` is a numeric column giving the order of rows, such as a row number
    within a file. Without it rows are ordered by their content, where identical
    rows are interchangeable; the numbers then depend neither on the order of the
    input nor on its partitioning.
    """
    # Several passes follow, so the rows are computed once and stored.
    stored = materialize(df.withColumn(_HASH, F.xxhash64(*keys)))
    repeated = materialize(repeated_groups(stored))
    groups = repeated.count()
    one = F.lit(1).cast("bigint").alias(name)
    if groups == 0:
        return stored.select(*df.columns, one)
    hot = hot_groups(repeated, hot_rows)
    if groups > few_groups:
        return _number(stored, keys, name, position, hot)
    several = repeated.select(_HASH)
    alone = stored.join(several, _HASH, "left_anti").select(*df.columns, one)
    together = stored.join(several, _HASH, "left_semi").select(*df.columns, _HASH)
    return alone.union(_number(together, keys, name, position, hot))


def _number(
    df: DataFrame, keys: list[str], name: str, position: str | None, hot: DataFrame
) -> DataFrame:
    columns = [c for c in df.columns if c != _HASH]
    rest = [
        f.name
        for f in df.schema
        if f.name not in [*keys, _HASH] and not isinstance(f.dataType, T.MapType)
    ]
    first = F.col(position) if position else F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")
    order = [F.col(_ORDER), *[F.col(c) for c in rest if c != position]]
    rows = df.withColumn(_ORDER, first)

    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    if hot.isEmpty():
        return rows.withColumn(name, plain).select(*columns, name)

    marked = rows.join(hot, _HASH, "left").drop(_HASH)
    usual = marked.where(F.col(_BITS).isNull()).withColumn(name, plain)
    by = _by_position if position else _by_content
    spread = by(marked.where(F.col(_BITS).isNotNull()), keys, order, name)
    return usual.select(*columns, name).union(spread.select(*columns, name))


def _with_earlier(rows: DataFrame, bucketed: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``__before``: the rows of ``bucketed`` in earlier buckets of the group.

    There is one size per bucket, stored so that Spark knows whether to broadcast.
    """
    earlier = (
        Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = bucketed.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(earlier), F.lit(0)).cast("bigint").alias("__before")
    starts = materialize(sizes.select(*keys, _BUCKET, before))
    return join_null_safe(rows, starts, [*keys, _BUCKET], extra=("__before",))


def _by_content(hot: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    # The leading bits of a hash keep its order.
    bucketed = hot.withColumn(_BUCKET, F.expr(f"shiftright({_ORDER}, 64 - {_BITS})"))
    # Copies collapse to one counted row before they are shuffled.
    distinct = bucketed.groupBy(*bucketed.columns).agg(F.count(F.lit(1)).alias(_COPIES))
    before = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    started = _with_earlier(distinct, bucketed, keys).withColumn(
        _START, F.col("__before") + F.coalesce(F.sum(_COPIES).over(before), F.lit(0))
    )
    # Write the copies out again, in chunks spread over all tasks.
    last_chunk = F.floor((F.col(_COPIES) - 1) / COPY_CHUNK).cast("bigint")
    chunks = started.withColumn(
        _CHUNK, F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk))
    ).repartition(*keys, _START, _CHUNK)
    offset = F.col(_CHUNK) * COPY_CHUNK
    size = F.least(F.lit(COPY_CHUNK).cast("bigint"), F.col(_COPIES) - offset)
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), size))
    return chunks.withColumn("__copy", copy).withColumn(
        name, F.col(_START) + offset + F.col("__copy")
    )


def _by_position(hot: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Buckets are intervals between percentiles, each cut into equal parts.

    The percentiles only balance the buckets; any cut points give the same numbers.
    """
    shares = [i / CUTS**2 for i in range(CUTS**2 + 1)]
    cuts = hot.groupBy(*keys).agg(F.percentile_approx(_ORDER, shares).alias("__cuts"))
    cut = join_null_safe(hot, materialize(cuts), keys, extra=("__cuts",))
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(_ORDER)))
    # Look among every CUTS-th cut first, then among the cuts that follow it.
    coarse = F.array(*[F.get("__cuts", F.lit(i * CUTS)) for i in range(1, CUTS)])
    first = below(coarse) * CUTS
    interval = first + below(F.slice("__cuts", first + 2, CUTS - 1))
    parts = F.pow(F.lit(2), F.greatest(F.lit(0), F.col(_BITS) - 8)).cast("bigint")
    low, high = F.get("__cuts", F.col("__interval")), F.get("__cuts", F.col("__interval") + 1)
    share = (F.col(_ORDER).cast("double") - low) / F.greatest(high.cast("double") - low, F.lit(1.0))
    part = F.least(parts - 1, F.greatest(F.lit(0), F.floor(share * parts)))
    bucketed = (
        cut.withColumn("__interval", interval)
        .withColumn(_BUCKET, (F.col("__interval") * parts + part).cast("bigint"))
        .drop("__cuts", "__interval")
    )
    within = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    return _with_earlier(bucketed, bucketed, keys).withColumn(
        name, F.col("__before") + F.row_number().over(within)
    )
