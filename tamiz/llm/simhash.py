"""SimHash near-duplicates: an index of fingerprints in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tamiz.session import materialize

SEED = 42
#: Fingerprints of a cell that are searched together; larger cells are cut further.
CELL = 1 << 15
#: Children of a node of the index.
FAN = 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """A bit is set if it is set in over half the hashes of the word shingles, repeats included."""
    found = [] if text is None else text.encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*[found[i:] for i in range(words)]))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``code``, the fingerprint as a signed long.

    A-Z count as lower case and words are what ASCII white space separates. A text of
    fewer words than a shingle is one shingle; a null text or one without words has
    fingerprint zero.
    """

    @F.pandas_udf("long")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in batch], dtype=np.uint64).view(np.int64))

    kept = [c for c in docs.columns if c not in (text, "code")]
    return docs.select(*kept, code(F.col(text)).alias("code"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence: neighbours there differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints sorted by Gray rank under a tree of masked patterns.

    Every node holds the bits that all codes below it share and its parent doesn't
    (``mask``), and their values (``pattern``). A search goes down from the top,
    adds up the differences on each node's own bits, and leaves a whole group as
    soon as they exceed the distance; at a leaf the sum is the Hamming distance.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        shared = np.full(len(codes), ~np.uint64(0))
        pattern = codes[self.order]
        levels = [(shared, pattern)]
        while len(shared) > 1:
            starts = np.arange(0, len(shared), FAN)
            every = np.bitwise_and.reduceat(pattern & shared, starts)
            none = np.bitwise_and.reduceat(~pattern & shared, starts)
            shared, pattern = every | none, every
            levels.append((shared, pattern))
        levels.reverse()
        # Only what a node adds to its parent's shared bits stays with it.
        self.levels = [levels[0]]
        for (above, _), (mask, pattern) in zip(levels, levels[1:]):
            own = mask & ~np.repeat(above, FAN)[: len(mask)]
            self.levels.append((own, pattern & own))

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code), as places in both arrays, within ``distance`` bits."""
        mask, pattern = self.levels[0]
        who = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        apart = np.bitwise_count((queries ^ pattern[0]) & mask[0]).astype(np.int64)
        for mask, pattern in self.levels[1:]:
            near = apart <= distance
            who, node, apart = who[near], node[near], apart[near]
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            inside = child < len(mask)
            who, child, apart = np.repeat(who, FAN)[inside], child[inside], np.repeat(apart, FAN)[inside]
            apart += np.bitwise_count((queries[who] ^ pattern[child]) & mask[child])
            node = child
        near = apart <= distance
        return who[near], self.order[node[near]]


def linked(codes: np.ndarray, distance: int, pairs: int = 1 << 20) -> list[tuple[int, int]]:
    """For each of the distinct ``codes`` that isn't the first of its component, that first one.

    Neighbours are found in blocks of queries and merged at once: at most ``pairs``
    are held, however dense the group.
    """
    index = GrayIndex(codes)
    root = np.arange(len(codes))
    block = max(1, pairs // len(codes))
    for at in range(0, len(codes), block):
        left, right = index.search(codes[at : at + block], distance)
        left = left + at
        while True:
            a, b = root[left], root[right]
            apart = a != b
            if not apart.any():
                break
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return [(i, int(r)) for i, r in enumerate(root) if r != i]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _choices(bits: list[int], distance: int) -> list[int]:
    """Masks that hold two of ``distance`` + 2 blocks of the given bit places."""
    parts = distance + 2
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    blocks = [sum(1 << b for b in bits[cuts[i] : cuts[i + 1]]) for i in range(parts)]
    return [a | b for a, b in combinations(blocks, 2)]


def cells(codes: DataFrame, distance: int, most: int = CELL) -> DataFrame:
    """Arrays of distinct ``codes`` such that every link of two codes lies in one of them.

    The 64 bits are cut into ``distance`` + 2 blocks; codes ``distance`` bits apart
    agree in two blocks at least, so each code goes to a cell for every choice of
    two. Cells of one code are dropped. A cell of more than ``most`` codes is cut by
    the same rule over the bits it doesn't share; for 2 bits that leaves 16 free bits
    and so 65,536 different codes in a cell at most, whatever the data.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    masks = _choices(list(range(64)), distance)

    def keyed(rows: DataFrame, choices: list[int]) -> DataFrame:
        cell = [
            F.struct(F.lit(i).alias("choice"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for i, m in enumerate(choices)
        ]
        return rows.select("code", F.explode(F.array(*cell)).alias("cell")).select("code", "cell.*")

    def busy(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
        return materialize(rows.join(sizes, ["choice", "key"]))

    def gathered(rows: DataFrame) -> DataFrame:
        # Few rows stand for much to search: dealt to all tasks, not by their size.
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(parts, "choice", "key")
        return dealt.groupBy("choice", "key").agg(F.collect_list("code").alias("codes")).select("codes")

    first = busy(keyed(codes, masks))
    found = gathered(first.where(F.col("n") <= most))
    large = first.where(F.col("n") > most)
    if not large.isEmpty():
        for i, mask in enumerate(masks):
            free = [b for b in range(64) if not mask >> b & 1]
            # The first cell's own bits are in every mask, so cells of one choice stay apart.
            within = busy(keyed(large.where(F.col("choice") == i), [mask | m for m in _choices(free, distance)]))
            found = found.unionByName(gathered(within))
    return found


def star_edges(groups: DataFrame, distance: int) -> DataFrame:
    """Links that span what is connected within each cell: ``a`` and ``b``, codes."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for codes in batch["codes"]:
                codes = np.sort(np.asarray(codes, dtype=np.int64))
                edges = np.array(linked(codes.view(np.uint64), distance), dtype=np.int64).reshape(-1, 2)
                yield pd.DataFrame({"a": codes[edges[:, 0]], "b": codes[edges[:, 1]]})

    return groups.mapInPandas(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it is connected to, for every node of an edge.

    Large and small stars in turn: each node hands its larger, then its smaller
    neighbours to the smallest one, until nothing changes. Every round is stored.
    """

    def state(rows: DataFrame):
        return rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while (now := state(edges)) != seen:
        seen = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        larger = materialize(larger.where("a != b").distinct())
        least = larger.groupBy("a").agg(F.min("b").alias("least"))
        joined = larger.join(least, "a")
        smaller = joined.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = materialize(smaller.unionByName(least.withColumnRenamed("least", "b")).distinct())
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def members(docs: DataFrame, distance: int = 2, words: int = 3, key: str = "doc_id") -> DataFrame:
    """``key``, ``text_hash``, ``code``, ``root`` and ``component_id`` for every row of ``docs``.

    ``root`` names the component: the smallest code in it.
    """
    light = docs.select(F.col(key), F.col("text"), F.xxhash64("text").alias("text_hash"))
    coded = materialize(fingerprints(light, words))
    codes = materialize(coded.groupBy("code").agg(F.min(key).alias("first")))
    if distance:
        edges = star_edges(cells(codes.select("code"), distance), distance)
        found = components(edges).withColumnRenamed("node", "code")
        codes = materialize(codes.join(found, "code", "left").withColumn("root", F.coalesce("root", "code")))
    else:
        codes = codes.withColumn("root", F.col("code"))
    named = codes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(codes.join(named, "root").select("code", "root", "component_id"))
    return coded.join(named, "code").select(key, "text_hash", "code", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 2, words: int = 3, key: str = "doc_id") -> DataFrame:
    """``key``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` for every row of ``docs``.

    Fingerprints at most ``distance`` bits apart are linked; ``component_id`` is the
    smallest key that can be reached, a row's own included. Copies are one
    fingerprint from the start, and links are only kept as far as they connect.

    Texts without words have fingerprint zero and are linked like any other. Repeated
    rows keep a row each. Null keys are never the smallest; a component with no other
    has a null id. An empty table gives no rows; other columns play no part.
    """
    return members(docs, distance, words, key).select(
        key, F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, distance: int = 2, words: int = 3, key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest key.

    Rows without a key come after all others; of rows with the same key the one whose
    text has the smallest hash stays, of equal rows one.
    """
    found = materialize(members(docs, distance, words, key).select("root", key, "text_hash"))
    row = F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("name"), F.col("text_hash").alias("text_hash"))
    kept = found.groupBy("root").agg(F.min(row).alias("row")).select("row.*")
    often = (
        found.select(row.alias("row")).groupBy("row").agg(F.count("*").alias("n")).select("row.*", "n")
        .withColumn("name", F.coalesce("name", F.lit(0)))
    )
    parts = ["unnamed", "name", "text_hash"]
    kept = materialize(kept.withColumn("name", F.coalesce("name", F.lit(0))).join(often, parts))
    marked = docs.select(
        F.struct("*").alias("_row"), F.col(key).isNull().alias("unnamed"),
        F.coalesce(F.col(key), F.lit(0)).alias("name"), F.xxhash64("text").alias("text_hash"),
    )
    single = marked.join(kept.where("n = 1"), parts, "left_semi")
    repeated = kept.where("n > 1")
    if not repeated.isEmpty():
        single = single.unionByName(marked.join(repeated, parts, "left_semi").dropDuplicates(parts))
    return single.select("_row.*")
