"""Exact duplicates: sorted runs of digests that partitions exchange and merge in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tamiz.session import materialize

#: A run comes from 2 ** RUN rows at most, unless asked for otherwise.
RUN = 17
#: Runs that meet in a round; one hexadecimal digit of the digest says which of them takes a record.
FAN = 16
#: SHA-256, then what verifies it: length in bytes and a second hash.
RECORD = np.dtype([("record", "S48"), ("named", "?"), ("id", "<i8"), ("row", "<i8"), ("count", "<i8")])
RUNS = "place long, prefix long, run binary"
REPEATED = "record binary, keep_id long, keep_row long, group_size long"


def digests(docs: DataFrame, text: Column, key: str, run: int = RUN) -> DataFrame:
    """Stored rows without their texts: ``id``, ``row``, the ``run`` it belongs to, and its 48-byte ``record``."""
    number = F.monotonically_increasing_id()
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    sizes = [F.lpad(F.hex(x), 16, "0") for x in (F.octet_length("text").cast("long"), F.xxhash64("text"))]
    record = F.unhex(F.concat(F.sha2("text", 256), *sizes))
    return materialize(rows.select("id", number.alias("row"), F.shiftright(number, run).alias("run"), record.alias("record")))


def merged(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """One run of several: ascending records, each once, with its best row and the rows it stands for.

    The sort is a natural merge sort, which takes what is in order already as it is.
    Records are equal in digest, length and second hash, or they stay apart. The best
    row has the largest (or smallest) id, null ids come last, then the smallest row.
    """
    found = np.concatenate(runs)
    found = found[np.argsort(found["record"], kind="stable")]
    new = np.ones(len(found), bool)
    new[1:] = found["record"][1:] != found["record"][:-1]
    first = np.flatnonzero(new)
    ids = ~found["id"] if largest else found["id"]
    best = np.lexsort((found["row"], ids, ~found["named"], np.cumsum(new)))
    out = found[best[first]]
    out["count"] = np.add.reduceat(found["count"], first) if len(first) else 0
    return out


def _cut(run: np.ndarray, place: int, prefix: int, level: int, levels: int) -> pd.DataFrame:
    """What a run sends in the next round: a slice for each value of the digest's next digit."""
    if level == levels:
        return _frame([(place, prefix, run.tobytes())])
    octet = np.ascontiguousarray(run["record"]).view(np.uint8).reshape(len(run), -1)
    digit = octet[:, level // 2] >> 4 if level % 2 == 0 else octet[:, level // 2] & 15
    ends = np.searchsorted(digit, np.arange(FAN + 1))
    slices = [(place // FAN, prefix * FAN + d, run[a:b].tobytes()) for d, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
    return _frame(slices)


def _merge(level: int, levels: int, largest: bool):
    def merge(part: pd.DataFrame) -> pd.DataFrame:
        run = merged([np.frombuffer(r, RECORD) for r in part["run"]], largest)
        return _cut(run, int(part["place"].iloc[0]), int(part["prefix"].iloc[0]), level, levels)

    return merge


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["place", "prefix", "run"])


def merge_tree(light: DataFrame, largest: bool, run: int = RUN) -> DataFrame:
    """All records that occur more than once: ``record``, ``keep_id``, ``keep_row`` and ``group_size``.

    Runs are sorted and made distinct where their rows lie. In every round ``FAN`` runs
    exchange slices, so that each then holds all their records with one more digit of
    the digest in common; every slice is merged at once. After as many rounds as it takes
    to join all runs, each digest is in one place, and no place ever held more than a
    run's worth of distinct records. Every round is stored.
    """
    runs = light.select("run").distinct().count()
    levels = 0
    while FAN**levels < runs:
        levels += 1

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def finish() -> pd.DataFrame:
            # Any spread over the places will do; the number of the first row gives one.
            place = (int(held[0]["row"][0]) * 0x9E3779B97F4A7C15 >> 32) % FAN**levels
            return _cut(merged(held, largest), place, 0, 0, levels)

        for batch in batches:
            rows = np.zeros(len(batch), RECORD)
            rows["record"] = np.frombuffer(b"".join(batch["record"]), RECORD["record"])
            rows["named"] = batch["id"].notna()
            rows["id"], rows["row"], rows["count"] = batch["id"].astype("Int64").fillna(0), batch["row"], 1
            if held and size + len(rows) > 1 << run:
                yield finish()
                held, size = [], 0
            held.append(rows)
            size += len(rows)
        if size:
            yield finish()

    found = materialize(light.select("id", "row", "record").mapInPandas(sort, RUNS))
    for level in range(1, levels + 1):
        found = materialize(found.groupBy("place", "prefix").applyInPandas(_merge(level, levels, largest), RUNS))

    def repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["run"]:
                rows = np.frombuffer(data, RECORD)
                rows = rows[rows["count"] > 1]
                records = np.ascontiguousarray(rows["record"]).view("V48").tolist()
                ids = pd.array(rows["id"], dtype="Int64")
                ids[~rows["named"]] = pd.NA
                yield pd.DataFrame({"record": records, "keep_id": ids, "keep_row": rows["row"], "group_size": rows["count"]})

    return materialize(found.mapInPandas(repeated, REPEATED))


def mark_copies(
    docs: DataFrame, key: str = "doc_id", text: str | Column = "text", keep: str = "smallest", run: int = RUN
) -> DataFrame:
    """For every row of ``docs``: ``key``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical; pass an expression as ``text`` to compare a
    normalised form. The row with the ``keep`` ("smallest" or "largest") key stays,
    of rows with the same key the first one, so exactly one of each group.

    A null text is empty. Null keys come after all others: a group without any other has
    a null ``keep_id``, and one of its rows stays. Keys are whole numbers. Other columns
    play no part and may have any name. An empty table gives no rows.

    Texts are read once; what moves are records of 73 bytes, and copies within a run
    are one record from the start, so a group may be of any size. What became of a
    repeated text goes back to each run once, and from there to the run's rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    light = digests(docs, F.col(text) if isinstance(text, str) else text, key, run)
    repeated = merge_tree(light, keep == "largest", run)
    answers = light.select("run", "record").distinct().join(repeated, "record")
    marked = light.join(answers, ["run", "record"], "left")
    alone = F.col("keep_row").isNull()
    return marked.select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row"))).alias("kept"),
        F.lower(F.hex(F.substring("record", 1, 32))).alias("text_sha256"),
    )
