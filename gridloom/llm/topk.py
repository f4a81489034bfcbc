"""Exact top-k inner products by block-at-a-time pruning.

Components are turned into integers; a component is two terms, its positive and its negative part, whose impacts are never
negative. Rows are sorted by id into document-range blocks. A block has, for each dimension, its largest and smallest value, which
are its term maxima; a query's bound for it is the sum over its own terms of weight times maximum. A query
takes the blocks in order of their bounds and scores them through their forward index, the block's rows, until a bound is below its
k-th score. Equal bounds are still scored, as ties go to smaller ids.

Queries are taken in blocks of a fixed number, and a fixed number of such blocks is broadcast at a time; these are one pass over the rows, in
which each task carries the k best rows of each query over all its batches and gives them out at its end, so that nothing broadcast or collected
grows with the data. A query starts with the k-th score among a fixed number of the broadcast rows as candidates, which is a true lower
bound, and goes on with the k-th of the rows that its task has seen.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without id; a
shorter vector has zeros in the missing places; rows with the query's own id are not its candidates; a query id that is
repeated is answered once, by its smallest vector; repeated candidates each count; with fewer than k candidates all are returned;
a score beyond 64 bits is an error, never a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm._shared import shared_folder, stored

SCHEMA = "query_id bigint, vec_id bigint, score bigint"


@dataclass(frozen=True)
class TopKConfig:
    k: int = 5
    scale: int = 256
    block: int = 64
    queries: int = 4096
    blocks_per_pass: int = 8
    seeds: int = 2048


def usable(vectors: DataFrame, config: TopKConfig) -> DataFrame:
    """vec_id and the integer components (v) of the rows that take part."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * config.scale).cast("bigint")).alias("v"))


def matrix(rows: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class BlockIndex:
    """Rows in blocks of consecutive ids, with the largest and smallest value of each dimension in a block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, size: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.cuts = np.arange(0, len(ids), size)
        self.size = size
        self.high = np.maximum.reduceat(self.rows, self.cuts, axis=0)
        self.low = np.minimum.reduceat(self.rows, self.cuts, axis=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, row ids and scores of the k best rows of each query that reach its floor."""
        exact = self._exact(queries)
        q, rows = (queries.astype(np.float64), self.rows.astype(np.float64)) if exact else (queries.astype(object), self.rows.astype(object))
        bounds = np.maximum(q, 0) @ self.high.T.astype(q.dtype) + np.minimum(q, 0) @ self.low.T.astype(q.dtype)
        order = np.argsort(-bounds, axis=1, kind="stable")
        least = floor.astype(q.dtype).copy()
        best = np.full((len(q), k), -np.inf if exact else None, q.dtype)
        if not exact:
            best[:] = -(1 << 200)
        named = np.full((len(q), k), np.iinfo(np.int64).max)
        live = np.arange(len(q))
        for r in range(len(self.cuts)):
            at = order[live, r]
            go = bounds[live, at] >= least[live]
            live, at = live[go], at[go]  # a query's further blocks have no larger bounds
            if not len(live):
                break
            for b in np.unique(at):
                who = live[at == b]
                cut = slice(self.cuts[b], self.cuts[b] + self.size)
                score = q[who] @ rows[cut].T
                ids = self.ids[cut]
                score[query_ids[who][:, None] == ids[None, :]] = -np.inf if exact else -(1 << 200)
                all_s = np.concatenate([best[who], score], 1)
                all_i = np.concatenate([named[who], np.broadcast_to(ids, score.shape)], 1)
                top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best[who], named[who] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
                least[who] = np.maximum(least[who], best[who, -1])
        p, c = np.nonzero((best >= floor.astype(q.dtype)[:, None]) & (best > (-np.inf if exact else -(1 << 200))))
        return p, named[p, c], best[p, c]

    def _exact(self, queries: np.ndarray) -> bool:
        a, b = (float(np.abs(x).max(initial=0)) for x in (queries, self.rows))
        return a * b * max(1, queries.shape[1]) < 2**53


class Best:
    """The k best rows seen of each query: positions, ids and scores, and the score that a further row must reach."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k, self.floor = k, floor.copy()
        self.at = self.ids = self.scores = np.zeros(0, np.int64)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        at, ids, scores = (np.concatenate([old, new.astype(np.int64)]) for old, new in ((self.at, at), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, ~scores, at))  # ~s falls as s grows, for every 64-bit number
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        full = rank == self.k - 1
        self.floor[at[full]] = np.maximum(self.floor[at[full]], scores[full])
        keep = rank < self.k
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]


def _search_blocks(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, config: TopKConfig) -> DataFrame:
    def into(best: Best, index: BlockIndex, ids: np.ndarray, queries: np.ndarray) -> None:
        for a in range(0, len(ids), config.queries):
            b = a + config.queries
            at, found, scores = index.search(ids[a:b], queries[a:b], best.floor[a:b], config.k)
            best.add(at + a, found, scores)

    seeds = Best(np.full(len(ids), np.iinfo(np.int64).min), config.k)
    into(seeds, BlockIndex(ids[: config.seeds], vectors[: config.seeds], config.block), ids, vectors)
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors, seeds.floor))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, floor = shared.value
        best = Best(floor, config.k)
        for x in batches:
            held = x.column(1).to_pylist()
            if not held:
                continue
            dims = max(queries.shape[1], *(len(h) for h in held))
            wide = np.zeros((len(queries), dims), np.int64)
            wide[:, : queries.shape[1]] = queries
            into(best, BlockIndex(x.column(0).to_numpy(), matrix(held, dims), config.block), ids, wide)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.at]), pa.array(best.ids), pa.array(best.scores)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(search, SCHEMA)


def top_k(vectors: DataFrame, every: int = 50, config: TopKConfig = TopKConfig(), folder: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    folder = folder or shared_folder(spark, "top-k")
    rows = stored(usable(vectors, config).repartitionByRange("vec_id").sortWithinPartitions("vec_id"), f"{folder}/rows")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id")
    found, ids, vs = [], [], []

    def flush() -> None:
        found.append(stored(_search_blocks(rows, np.array(ids), matrix(vs, max(map(len, vs))), config), f"{folder}/found-{len(found)}"))

    for r in asked.toLocalIterator():
        ids.append(r[0])
        vs.append(r[1])
        if len(ids) == config.queries * config.blocks_per_pass:
            flush()
            ids, vs = [], []
    if ids:
        flush()
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.union(f)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return all_.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score")
