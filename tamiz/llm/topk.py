"""Exact top-k by inner product over an impact-ordered index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tamiz.session import materialize

#: Levels to which the components of a dimension are quantised: as many posting segments.
LEVELS = 64
#: Stands for a null id within a block: the largest of all.
NO_ID = 2**63 - 1
FOUND = "query long, query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, scale: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id`` and ``vector``: floor(``scale`` * x) of every component x, taken as double.

    Rows that are null, empty, or hold a null or non-finite component are left out.
    Scores are exact while sums of products stay below 2**53.
    """
    x = F.col(vector)
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return rows.where(x.isNotNull() & (F.size(x) > 0) & usable).select(
        F.col(key).alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector")
    )


class ImpactIndex:
    """Posting segments of a block of vectors.

    A segment holds the vectors whose component in one dimension falls to one level.
    A query gives each segment an impact: the least product with a component of the
    level, above the least product in the whole dimension.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.low = vectors.min(axis=0)
        self.width = np.maximum(1, -(-(vectors.max(axis=0) - self.low + 1) // LEVELS))
        level = (vectors - self.low) // self.width
        rows, dims = vectors.shape
        segment = (np.arange(dims) * LEVELS + level).T.ravel()
        order = np.argsort(segment, kind="stable")
        self.postings = np.tile(np.arange(rows, dtype=np.int32), dims)[order]
        self.sizes = np.bincount(segment, minlength=dims * LEVELS)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.edges = self.low[:, None] + np.arange(LEVELS) * self.width[:, None]
        self.dimension = np.repeat(np.arange(dims), LEVELS)

    def search(self, query: np.ndarray, own: int | None, k: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the ``k`` best but ``own``; equal scores by smaller id.

        Segments are taken by descending impact, a quarter of the postings at a time.
        A vector's accumulator is a lower bound of its score above the base, and what
        it can still gain is bounded by the sum over dimensions of the larger of a
        level's width and the largest impact still to come. Once no more vectors than
        can be scored cheaply may reach the k-th best lower bound, those are scored
        exactly; the proof is the bound, and without it all segments are taken.
        """
        rows = len(self.ids)
        one, other = query[:, None] * self.edges, query[:, None] * (self.edges + self.width[:, None] - 1)
        least = np.minimum(one, other)
        slack = np.abs(query) * (self.width - 1)
        impact = (least - least.min(axis=1)[:, None]).ravel()
        order = np.argsort(-impact, kind="stable")
        order = order[self.sizes[order] > 0]
        taken = np.cumsum(self.sizes[order])
        heap = np.zeros(rows)
        members = np.arange(rows)
        first = 0
        few = max(4 * k, rows // 16)
        for part in range(1, rounds + 1):
            last = int(np.searchsorted(taken, taken[-1] * part // rounds, side="right")) if part < rounds else len(order)
            chosen = order[first:last]
            first = max(first, last)
            if len(chosen):
                sizes = self.sizes[chosen]
                runs = [self.postings[a:b] for a, b in zip(self.starts[chosen], self.starts[chosen] + sizes)]
                heap += np.bincount(np.concatenate(runs), np.repeat(impact[chosen].astype(float), sizes), rows)
            rest = np.zeros(len(query))
            np.maximum.at(rest, self.dimension[order[first:]], impact[order[first:]])
            open_ = heap if own is None else np.where(self.ids == own, -np.inf, heap)
            if rows <= k + 1:
                break
            bar = np.partition(open_, rows - k)[rows - k] if rows > k else -np.inf
            # What is still to come, or has come but for the place within its level.
            gain = np.where(rest > 0, rest + slack, slack).sum()
            members = np.flatnonzero(open_ + gain >= bar)
            if len(members) <= few:
                break
        if own is not None:
            members = members[self.ids[members] != own]
        scores = self.vectors[members] @ query
        best = np.lexsort((self.ids[members], -scores))[:k]
        return scores[best], self.ids[members][best]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 4096, query_rows: int = 1024
) -> DataFrame:
    """The ``k`` highest integer inner products of each query with all vectors but its own.

    Both tables have ``vec_id`` and ``vector`` as of ``integer_vectors``. Returns
    ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``; of equal scores the smaller
    ``vec_id`` first; all of a query's candidates if they are fewer than k.

    Vectors are dealt by hash into blocks of about ``block_rows``, each indexed where
    it lies, queries into groups of about ``query_rows`` that are sent to every block.
    Each block returns its own k best, so the exact k best are among them. A vector
    only meets queries of its length. A repeated vector is a candidate as often as it
    occurs, a repeated query answered once; rows of the query's ``vec_id`` are never
    its candidates. Null ids are vectors and queries like any other and come last among
    equals. Empty tables give no rows.
    """
    vectors = materialize(vectors.withColumn("length", F.size("vector")))
    named = materialize(
        queries.select("vec_id", "vector").distinct()
        .select("vec_id", "vector", F.size("vector").alias("length"), F.xxhash64("vec_id", "vector").alias("query"))
    )
    blocks = max(1, -(-vectors.count() // block_rows))
    groups = max(1, -(-named.count() // query_rows))
    every_group, every_block = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, blocks))
    dealt = vectors.select(
        "length", "vec_id", "vector", every_group.alias("part"),
        # By row, so that copies of one row don't meet in one block.
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"),
    )
    asked = named.select(
        "length", "query", "vec_id", "vector", F.pmod("query", F.lit(groups)).cast("int").alias("part"), every_block.alias("block")
    )

    def within(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if held.empty or wanted.empty:
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})
        index = ImpactIndex(held["vec_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64), np.stack(held["vector"]))
        out = []
        for query, own, vector in zip(wanted["query"], wanted["vec_id"], wanted["vector"]):
            own = None if pd.isna(own) else int(own)
            scores, ids = index.search(np.asarray(vector), own, k)
            out.append(pd.DataFrame({"query": query, "query_id": own, "vec_id": ids, "score": scores}))
        found = pd.concat(out).astype({"query_id": "Int64", "vec_id": "Int64"})
        found["vec_id"] = found["vec_id"].mask(found["vec_id"] == NO_ID)
        return found

    keys = ["length", "block", "part"]
    found = dealt.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(within, FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
