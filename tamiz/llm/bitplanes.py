"""Centroid clustering over bit planes: dot products as weighted counts of common bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tamiz.session import materialize

#: Components of a vector: the bits of a plane.
WIDTH = 64
#: Components from here on can't be squared and summed in 64 bits; such vectors aren't kept.
LARGEST = 1 << 27
#: Vectors that meet the centroids at once.
BLOCK = 2048


def integer_vectors(rows: DataFrame, scale: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id`` and ``vector``: floor(``scale`` * x) of every component x, taken as double.

    Kept are the vectors of exactly ``WIDTH`` components, none null or non-finite, and
    each below ``LARGEST`` in size after scaling.
    """
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * scale))
    usable = F.forall(
        F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < float(LARGEST - 1))
    )
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) == WIDTH) & usable).select(
        F.col(key).alias("vec_id"), x.alias("vector")
    )


def bits_for(low: int, high: int) -> int:
    """Bits in which all numbers from ``low`` to ``high`` have a two's complement."""
    return max(int(low if low >= 0 else ~low).bit_length(), int(high if high >= 0 else ~high).bit_length()) + 1


def weights(bits: int) -> np.ndarray:
    """What a bit of each plane stands for; the last one, the sign, counts negative."""
    w = np.int64(1) << np.arange(bits, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def planes(vectors: np.ndarray, bits: int) -> np.ndarray:
    """Bit b of all 64 components of each vector in one word: shape (vectors, ``bits``)."""
    taken = vectors[:, None, :] >> np.arange(bits)[None, :, None] & 1
    return np.packbits(taken.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpacked(packed: np.ndarray) -> np.ndarray:
    """The vectors whose ``planes`` these are."""
    rows, bits = packed.shape
    set_ = np.unpackbits(np.ascontiguousarray(packed).view(np.uint8).reshape(rows, bits, 8), axis=2, bitorder="little")
    return np.einsum("b,rbc->rc", weights(bits), set_, dtype=np.int64, casting="unsafe")


def dots(packed: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact inner products of two sets of packed vectors.

    The product of two planes is the number of components whose bit is set in both;
    it weighs as much as the planes' bits together.
    """
    out = np.zeros((len(packed), len(others)), np.int64)
    for i, wide in enumerate(weights(packed.shape[1])):
        for j, high in enumerate(weights(others.shape[1])):
            out += np.bitwise_count(packed[:, i, None] & others[None, :, j]) * (wide * high)
    return out


class Centroids:
    """Integer centroids and their planes."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.packed = planes(vectors, bits_for(vectors.min(), vectors.max()))
        self.norms = (vectors * vectors).sum(axis=1)

    def nearest(self, packed: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; of equally near ones the first."""
        number, distance = np.empty(len(packed), np.int64), np.empty(len(packed), np.int64)
        for at in range(0, len(packed), BLOCK):
            some = slice(at, at + BLOCK)
            apart = norms[some, None] - 2 * dots(packed[some], self.packed) + self.norms
            number[some] = apart.argmin(axis=1)
            distance[some] = apart.min(axis=1)
        return number, distance


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """Stored ``vec_id``, ``planes`` (a word for each bit that the table's components need) and ``norm``."""
    ends = vectors.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    bits = bits_for(ends[0] or 0, ends[1] or 0)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.iloc[at : at + BLOCK]
                found = np.stack(some["vector"]).astype(np.int64)
                words = planes(found, bits)
                yield pd.DataFrame({
                    "vec_id": some["vec_id"].astype("Int64"), "planes": [w.tobytes() for w in words],
                    "norm": (found * found).sum(axis=1),
                })

    return materialize(vectors.mapInPandas(pack, "vec_id long, planes binary, norm long"))


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u8").reshape(len(column), -1)


def _totals(packed: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """For every centroid that is nearest to any vector: how many, and their sum by component.

    A task sends a row for each centroid and component; the driver gets as many in all.
    """

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(centroids.vectors)
        sums, counts = np.zeros((k, WIDTH), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.iloc[at : at + BLOCK]
                words = _words(some["planes"])
                number, _ = centroids.nearest(words, some["norm"].to_numpy())
                counts += np.bincount(number, minlength=k)
                np.add.at(sums, number, unpacked(words))
        used = np.flatnonzero(counts)
        yield pd.DataFrame({
            "cluster": np.repeat(used, WIDTH), "component": np.tile(np.arange(WIDTH), len(used)),
            "n": np.repeat(counts[used], WIDTH), "total": sums[used].ravel(),
        })

    parts = packed.mapInPandas(total, "cluster long, component int, n long, total long")
    rows = parts.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for row in rows:
        found.setdefault(row["cluster"], (row["n"], [0] * WIDTH))[1][row["component"]] = row["total"]
    return found


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the smallest SHA-256 of seed and id; rows of the same id by their components."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("vector", place.alias("place")).orderBy("place", "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64).reshape(-1, WIDTH)


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int = 0) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` for every vector.

    ``vectors`` are as of ``integer_vectors``. Each round assigns every vector to the
    centroid of the smallest squared distance, ties to the smaller number, and moves
    every centroid that has vectors to the floor of their mean; at the end vectors are
    assigned once more. All numbers are exact. Centroids start as ``first_centroids``;
    with fewer vectors than ``k`` there are as many centroids as vectors.

    Vectors are packed into bit planes once and stored; a round reads the planes, and
    what leaves a task are sums, a row for each centroid and component, however many
    vectors are alike. Null ids are vectors like any other, repeated rows keep a row
    each. An empty table gives no rows; other columns play no part.
    """
    schema = "vec_id long, cluster int, distance long"
    start = first_centroids(vectors, k, seed)
    if not len(start):
        nothing = vectors.sparkSession.createDataFrame([], schema)
        sums = [F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")]
        return nothing.select("*", *sums, F.lit("").alias("centroid_sha256"))
    packed = packed_vectors(vectors)
    centroids = Centroids(start)
    for _ in range(rounds):
        moved = centroids.vectors.copy()
        for number, (n, total) in _totals(packed, centroids).items():
            moved[number] = [t // n for t in total]
        centroids = Centroids(moved)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, distance = centroids.nearest(_words(batch["planes"]), batch["norm"].to_numpy())
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "cluster": number, "distance": distance})

    assigned = materialize(packed.mapInPandas(assign, schema))
    by_cluster = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.vectors.tolist()]
    # A number and a name for each of the k centroids.
    inertia = F.array(*[F.lit(by_cluster.get(i, 0)).cast("long") for i in range(len(names))])
    return assigned.select(
        "*",
        inertia[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(by_cluster.values())).cast("long").alias("inertia"),
        F.array(*map(F.lit, names))[F.col("cluster")].alias("centroid_sha256"),
    )
