"""Lines of text files, read and stored once, and the records they make up.

A quoted cell may hold line breaks, so whether a line begins a record depends on the
lines before it. Each line only does one of four things to a quote, whether open or
not, and so does a whole split; the splits of a file are chained by what they do, a row
for each, and then every split knows how it begins. No file is read in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tamiz.session import ZSTD, materialize

# What a line, or a split, does to a quote: leaves it, closes it, opens it, turns it over.
LEAVES, CLOSES, OPENS, TURNS = 0, 1, 2, 3

# Lines that hold nothing but blanks.
NOTHING = r"\A[\x00-\x20]*\z"

UNCLOSED = "comillas sin cerrar"
AUTO = "auto"

# A quoted cell up to its closing quote, or to the end if it has none. Possessive, so that
# long cells need no stack.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'


def _body(sep: str) -> str:
    """Whole cells, each with the separator after it."""
    s = re.escape(sep)
    return rf'(?:(?:{_QUOTED}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+'


def turn_of(line: Column, sep: str) -> Column:
    """What ``line`` does to a quote. A quote inside an unquoted cell is a mark like any other."""
    s = re.escape(sep)
    opened = rf"{_body(sep)}{_QUOTED}\z"
    from_closed = line.rlike(rf"\A{opened}")
    stays = line.rlike(rf"\A{_QUOTED[1:]}\z") | line.rlike(rf'\A{_QUOTED[1:]}"[^{s}]*+{s}{opened}')
    turned = (
        F.when(from_closed & stays, OPENS).when(from_closed, TURNS).when(stays, LEAVES).otherwise(CLOSES)
    )
    return F.when(F.contains(line, F.lit('"')), turned).otherwise(LEAVES).cast("tinyint")


def cut(record: Column, sep: str) -> Column:
    """The cells of a record, as many as it has: without their quotes, null if empty."""
    s = re.escape(sep)
    quoted = F.contains(record, F.lit('"'))
    raw = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(rf'{s}({_QUOTED}"[^{s}]*+|[^{s}]*+)'), F.lit(1))

    def plain(cell: Column) -> Column:
        inner = F.regexp_extract(cell, rf'\A({_QUOTED})"', 1)
        whole = F.replace(F.substring(inner, 2, 1 << 30), F.lit('""'), F.lit('"'))
        rest = F.substr(cell, F.length(inner) + 2)
        return F.nullif(F.when(inner != "", F.concat(whole, rest)).otherwise(cell), F.lit(""))

    return F.when(quoted, F.transform(raw, plain)).otherwise(
        F.transform(F.split(record, s), lambda c: F.nullif(c, F.lit("")))
    )


def read_lines(spark: SparkSession, paths: str | list[str], glob: str, sep: str, keep: Column) -> DataFrame:
    """Every line of the matching files, stored: the one time that the files are read.

    ``path``, ``block`` (where its split begins), ``line`` (ascending within a split), ``value``
    (bytes), ``turn``, ``nothing``, ``separated`` and ``utf8`` (whether its bytes are valid).
    Line ends are never part of a UTF-8 character, so each line can be judged alone.
    """
    if len(sep) != 1:
        raise ValueError("the separator must be one character")
    value = F.col("value")
    lines = (
        spark.read.format("text")
        .option("pathGlobFilter", glob)
        .load(paths)
        .where(keep)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            value.cast("binary").alias("value"),
            turn_of(value, sep).alias("turn"),
            value.rlike(NOTHING).alias("nothing"),
            F.contains(value, F.lit(sep)).alias("separated"),
            F.is_valid_utf8(value).alias("utf8"),
        )
    )
    return materialize(lines, **ZSTD)


def decoded(value: Column, encoding: str, utf8: Column) -> Column:
    """Bytes as text: in ``encoding``, or with ``auto`` UTF-8 where the whole file is valid, else Latin-1."""
    if encoding != AUTO:
        return F.decode(value, encoding)
    return F.when(utf8, value.cast("string")).otherwise(F.decode(value, "ISO-8859-1"))


def file_facts(lines: DataFrame) -> DataFrame:
    """Stored, a row for each file with a header: its line and bytes, whether a quote stays open after any line, encoding."""
    candidate = F.when((F.col("block") == 0) & ~F.col("nothing"), F.col("line"))
    found = lines.groupBy("path").agg(
        F.min(candidate).alias("header_line"),
        F.bool_or(F.col("turn").isin(OPENS, TURNS)).alias("open_quote"),
        F.bool_and("utf8").alias("utf8"),
    )
    found = materialize(found.where("header_line IS NOT NULL"))
    # Looked up by number: an aggregate that carries bytes would sort all lines.
    numbers = found.select(F.col("header_line").alias("line"))
    headers = lines.where("block = 0").select("line", "value").join(numbers, "line", "left_semi")
    headers = headers.select(F.col("line").alias("header_line"), F.col("value").alias("header_value"))
    return materialize(found.join(headers, "header_line").select("path", "header_line", "header_value", "open_quote", "utf8"))


def _states(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``open_after`` and ``depends``: the state behind each row if the chain begins closed, and whether that matters."""
    window = Window.partitionBy(*by).orderBy(order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.col("turn")
    counted = rows.withColumn("_turns", F.sum((turn == TURNS).cast("long")).over(upto))
    setting = F.when(turn.isin(CLOSES, OPENS), F.struct((turn == OPENS).alias("open"), F.col("_turns").alias("turns")))
    last = counted.withColumn("_set", F.last(setting, ignorenulls=True).over(upto))
    since = F.col("_turns") - F.coalesce(F.col("_set.turns"), F.lit(0))
    return last.withColumns({
        "open_after": F.coalesce(F.col("_set.open"), F.lit(False)) != (since % 2 == 1),
        "depends": F.col("_set").isNull(),
    }).drop("_turns", "_set")


def records(lines: DataFrame) -> DataFrame:
    """Lines of files with open quotes as records: ``path``, ``line`` (its first), ``value`` (joined by line feeds),
    ``nothing``, ``separated`` and ``unclosed``.

    Where a quote is never closed, that record ends with its first line and is marked;
    what follows it belongs to no record.
    """
    within = Window.partitionBy("path", "block").orderBy("line")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = _states(lines, ["path", "block"], "line").withColumns({
        "before": F.coalesce(F.lag("open_after").over(within), F.lit(False)),
        "before_depends": F.coalesce(F.lag("depends").over(within), F.lit(True)),
    })
    known = materialize(known, **ZSTD)
    # A split does what its last line has come to.
    end = F.max_by(F.struct("open_after", "depends"), "line")
    splits = known.groupBy("path", "block").agg(end.alias("end"))
    does = F.when(F.col("end.depends"), F.when(F.col("end.open_after"), TURNS).otherwise(LEAVES)).otherwise(
        F.when(F.col("end.open_after"), OPENS).otherwise(CLOSES)
    )
    in_file = Window.partitionBy("path").orderBy("block")
    chained = _states(splits.select("path", "block", does.alias("turn")), ["path"], "block")
    begins = chained.withColumn("begins", F.coalesce(F.lag("open_after").over(in_file), F.lit(False)))
    placed = known.join(begins.select("path", "block", "begins"), ["path", "block"])
    placed = placed.withColumns({
        "inside": F.col("before") != (F.col("before_depends") & F.col("begins")),
        "goes_on": F.col("open_after") != (F.col("depends") & F.col("begins")),
    }).withColumn("first", F.last(F.when(~F.col("inside"), F.col("line")), ignorenulls=True).over(upto))
    placed = placed.select("path", "block", "line", "value", "nothing", "separated", "inside", "goes_on", "first")
    placed = materialize(placed, **ZSTD)

    # The record that a split goes on with began in an earlier one.
    starts = placed.groupBy("path", "block").agg(F.max("first").alias("latest"), F.max_by("goes_on", "line").alias("open"))
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    starts = starts.select(
        "path", "block",
        F.last("latest", ignorenulls=True).over(earlier).alias("carried"),
        F.max_by("open", "block").over(whole).alias("unclosed"),
        F.last("latest", ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("final"),
    )
    owned = placed.join(starts, ["path", "block"]).withColumn("record", F.coalesce("first", "carried"))
    lost = F.col("unclosed") & (F.col("record") == F.col("final"))
    owned = owned.where(~lost | (F.col("line") == F.col("record")))
    alone = (~F.col("inside") & ~F.col("goes_on")) | lost
    single = owned.where(alone).select("path", "line", "value", "nothing", "separated", lost.alias("unclosed"))
    # Splits lie in a file as their blocks do, and lines in a split as they are numbered.
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = owned.where(~alone).groupBy("path", F.col("record").alias("line")).agg(parts.alias("parts"))
    glued = F.array_join(F.transform("parts", lambda p: p["value"].cast("string")), "\n").cast("binary")
    several = joined.select(
        "path", "line", glued.alias("value"), F.lit(False).alias("nothing"), F.lit(True).alias("separated"), F.lit(False).alias("unclosed")
    )
    return single.unionByName(several)
