"""Proportional stratified interleaving: shards that all have the corpus's mixture of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tamiz.session import materialize

#: Hex digits of the shuffle key that cut a source into pieces to be ranked apart: 4,096 pieces.
PIECE_DIGITS = 3
#: Equal slices of the fractional rank that are sorted apart.
SLICES = 16384


def _hex_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


def interleave(
    rows: DataFrame,
    shards: int,
    stratum: str = "source",
    key: str = "doc_id",
    seed: str = "0",
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Give every row a ``shard`` and a ``slot`` in it.

    Rows are shuffled within their stratum by the MD5 of seed and key, ranked, and
    sorted by (rank + offset of the stratum) / rows of the stratum; shard k takes
    the k-th of ``shards`` equal cuts. Counts of shards differ by one at most, and
    those of a stratum in a cut of equal width by one at most. The offset, below one,
    keeps strata of a single row from meeting at the same place.

    No stratum is ranked in one task: the shuffle key's first digits cut it into
    pieces, counted first, and the sorted order is built from slices in the same
    way. Only the counts of slices, of which there are ``SLICES`` at most, are
    summed up in one place.

    A null stratum is a stratum of its own and a null key an empty text. Rows with
    the same key are ordered by ``ties``; rows that agree there too may take each
    other's places. An empty table stays empty. Result columns replace columns of
    the same name; columns beginning with ``_il_`` are lost.
    """
    group = F.concat_ws(":", F.col(stratum).isNotNull().cast("string"), F.col(stratum).cast("string"))
    keyed = rows.select(
        *[c for c in rows.columns if c not in ("shard", "slot") and not c.startswith("_il_")],
        group.alias("_il_group"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("_il_hash"),
    ).withColumn("_il_piece", _hex_number(F.col("_il_hash"), PIECE_DIGITS))
    keyed = materialize(keyed)

    pieces = keyed.groupBy("_il_group", "_il_piece").agg(F.count("*").alias("_il_rows"))
    whole = Window.partitionBy("_il_group")
    before = whole.orderBy("_il_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "_il_group",
        "_il_piece",
        F.coalesce(F.sum("_il_rows").over(before), F.lit(0)).alias("_il_before"),
        F.sum("_il_rows").over(whole).alias("_il_size"),
    )
    within = Window.partitionBy("_il_group", "_il_piece").orderBy("_il_hash", *ties)
    offset = _hex_number(F.md5(F.concat_ws("|", F.lit(seed), "_il_group")), 8) / F.lit(float(2**32))
    ranked = (
        keyed.join(pieces, ["_il_group", "_il_piece"])
        .withColumn("_il_rank", F.col("_il_before") + F.row_number().over(within) - 1)
        .withColumn("_il_at", (F.col("_il_rank") + offset) / F.col("_il_size"))
        .withColumn("_il_slice", F.floor(F.col("_il_at") * SLICES))
        .drop("_il_piece", "_il_before", "_il_size", "_il_rank")
    )
    ranked = materialize(ranked)

    slices = ranked.groupBy("_il_slice").agg(F.count("*").alias("_il_rows"))
    everything = Window.partitionBy()
    earlier = everything.orderBy("_il_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "_il_slice",
        F.coalesce(F.sum("_il_rows").over(earlier), F.lit(0)).alias("_il_before"),
        F.sum("_il_rows").over(everything).alias("_il_total"),
    )
    order = Window.partitionBy("_il_slice").orderBy("_il_at", "_il_group", "_il_hash", *ties)
    placed = ranked.join(slices, "_il_slice").withColumn(
        "_il_position", F.col("_il_before") + F.row_number().over(order) - 1
    )
    shard = F.expr(f"_il_position * {shards} div _il_total")
    first = F.expr(f"(shard * _il_total + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_il_position") - first)
        .drop("_il_group", "_il_hash", "_il_at", "_il_slice", "_il_before", "_il_total", "_il_position")
    )


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, size in bytes plus one, and CRC-32 of the text; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        "source",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
