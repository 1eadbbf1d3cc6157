"""Nearest neighbours by a block matrix join of int8 tiles.

Candidates are dealt to groups of a bounded size by a hash of their id; a task holds a
group as blocks.  Each vector is stored as int8 codes with a scale, the norm of what the
codes stand for and the norm of what they miss.  The queries, a twentieth of the rows, are
copied to every group and pass its blocks in blocks of their own.  A tile is a query block
and a candidate block: the integer product of its codes, scaled, gives every inner product
``x.y`` up to ``coded(x) * missed(y) + missed(x) * |y|``.  A candidate goes on if its upper
bound reaches the k-th largest lower bound of its query in the tile; so none of the k best
is lost.  What is left is recomputed in double precision from the original vectors.  Heaps
merge the tiles' lists of a query inside the group; the groups' lists are ranked last.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import prepare

#: Vectors of a query block and of a candidate block, and components of a group at most.
QUERY_ROWS, BLOCK_ROWS, GROUP_COMPONENTS = 512, 4096, 1 << 22
#: Codes of at most so many dimensions have products that float32 holds exactly.
EXACT_WIDTH = 1024
#: Relative allowance for rounding in the bounds.
SLACK = 1e-9

_FOUND = "query_id long, vec_id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes, and per vector: scale, coded norm, missed norm, norm."""
    x = x.astype(np.float64)
    scale = np.maximum(np.abs(x).max(axis=1, initial=0.0) / 127, np.finfo(float).tiny)
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    coded = codes * scale[:, None]
    norms = [np.sqrt((v * v).sum(axis=1)) for v in (coded, x - coded, x)]
    return codes, np.stack([scale, *norms], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of int8 rows, as float64."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_WIDTH):
        part = slice(at, at + EXACT_WIDTH)
        total += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return total


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in order of dimension."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k].astype(np.float64) * b[:, k].astype(np.float64)
    return total


def tile(q: tuple, c: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of every query row: sizes, ids and scores, best first.

    ``q`` and ``c`` are (ids, vectors, codes, bounds).  A row of the query's own id
    is no candidate; ties go to the smaller id.
    """
    q_ids, q_vectors, q_codes, q_bounds = q
    c_ids, c_vectors, c_codes, c_bounds = c
    rows, columns = [], []
    for at in range(0, len(q_ids), 128):
        part = slice(at, at + 128)
        near = products(q_codes[part], c_codes) * q_bounds[part, :1] * c_bounds[:, 0]
        error = q_bounds[part, 1:2] * c_bounds[:, 2] + q_bounds[part, 2:3] * c_bounds[:, 3]
        error += SLACK * q_bounds[part, 3:4] * c_bounds[:, 3]
        own = q_ids[part, None] == c_ids
        low = np.where(own, -np.inf, near - error)
        if low.shape[1] > k:
            least = np.partition(low, -k, axis=1)[:, -k]
            keep = ~(near + error < least[:, None]) & ~own
        else:
            keep = ~own
        r, col = np.nonzero(keep)
        rows.append(r + at)
        columns.append(col)
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    scores = exact(q_vectors[rows], c_vectors[columns])
    ids = c_ids[columns]
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    sizes = np.bincount(rows, minlength=len(q_ids))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = place < k
    return np.minimum(sizes, k), ids[kept], scores[kept]


def _rows(batch: pa.RecordBatch, kind) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors) of a batch."""
    ids, lists = batch.column(2).to_numpy(), batch.column(3)
    dims = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy().astype(kind) + kind(0)  # one zero, not two
    starts = np.cumsum(dims) - dims
    for dim in sorted(set(dims.tolist())):
        chosen = np.flatnonzero(dims == dim)
        yield dim, ids[chosen], flat[starts[chosen, None] + np.arange(dim)]


class _Group:
    """Collects the candidates of a group, then answers query blocks."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.held, self.blocks = k, {}, 0, None

    def add(self, dim: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.parts.setdefault(dim, []).append((ids, vectors))
        self.held += vectors.size
        if self.held > 2 * GROUP_COMPONENTS:  # many copies: no group is so large otherwise
            self.parts = {d: [self._distinct(p)] for d, p in self.parts.items()}
            self.held = 0

    def _distinct(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """Each (id, vector) once; of ids that share a vector the k + 1 smallest can appear."""
        ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
        _, number = np.unique(whole, return_inverse=True)
        order = np.lexsort((ids, number))
        ids, number = ids[order], number[order]
        first = np.ones(len(ids), dtype=bool)
        first[1:] = (number[1:] != number[:-1]) | (ids[1:] != ids[:-1])
        order, number = order[first], number[first]
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        place = np.arange(len(number)) - np.repeat(starts, np.diff(np.r_[starts, len(number)]))
        kept = np.sort(order[place <= self.k])
        ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids[kept], vectors[kept]

    def _block_list(self, dim: int) -> list[tuple]:
        if self.blocks is None:
            self.blocks = {}
            for d, parts in self.parts.items():
                ids, vectors = self._distinct(parts)
                self.blocks[d] = [
                    (ids[a : a + BLOCK_ROWS], v := vectors[a : a + BLOCK_ROWS], *quantise(v))
                    for a in range(0, len(ids), BLOCK_ROWS)
                ]
            self.parts = {}
        return self.blocks.get(dim, [])

    def answer(self, dim: int, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), QUERY_ROWS):
            part = slice(at, at + QUERY_ROWS)
            query = ids[part], vectors[part], *quantise(vectors[part])
            heaps: dict[int, list] = {}
            for block in self._block_list(dim):
                _merge(heaps, ids[part], tile(query, block, self.k), self.k)
            rows = [(q, -near, score) for q, heap in heaps.items() for score, near in heap]
            if rows:
                types = pa.int64(), pa.int64(), pa.float64()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    names=["query_id", "vec_id", "score"],
                )


def _merge(heaps: dict[int, list], queries: np.ndarray, found: tuple, k: int) -> None:
    """Merge a tile's lists into one heap for each query; the worst entry is the smallest."""
    sizes, ids, scores = (x.tolist() for x in found)
    at = 0
    for query, n in zip(queries.tolist(), sizes, strict=True):
        heap = heaps.setdefault(query, [])
        for j in range(at, at + n):
            entry = (scores[j], -ids[j])
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                break  # a list is in order
        at += n


def _searcher(k: int, double: bool):
    """Each group's candidates come first, then the queries."""
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = None, None
        for batch in batches:
            g, side = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(side) != 0)) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if stop == start:
                    continue
                if g[start] != at:
                    group, at = _Group(k), g[start]
                for dim, ids, vectors in _rows(batch.slice(start, stop - start), kind):
                    if side[start] == 0:
                        group.add(dim, ids, vectors)
                    else:
                        yield from group.answer(dim, ids, vectors)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query.

    Vectors that are null, empty, zero or have null or non-finite components, and
    rows without an id, take no part.  Only vectors of the query's dimension are
    candidates, and none of its own id.  Of an id's repeated rows one counts; if they
    differ, all are candidates and the smallest is the query.  A query without any
    candidate has no rows.
    """
    spark = prepare(vectors.sparkSession)
    element = vectors.schema[vector].dataType.elementType
    double = not isinstance(element, T.FloatType)
    wide = "double" if double else "float"
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    usable = vectors.where(
        F.col(vector).isNotNull() & F.col(key).isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    ).withColumn("__query", is_query).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{wide}>").alias("v"), "__query"
    )
    queries = usable.where("__query").groupBy("id").agg(F.min("v").alias("v"))
    n, components = usable.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
    # as few groups as memory allows, as every query goes to each, but work for all cores
    groups = max(
        1, -(-(components or 0) // GROUP_COMPONENTS),
        min(spark.sparkContext.defaultParallelism, n // BLOCK_ROWS),
    )
    dealt = usable.select(
        F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("side"), "id", "v"
    )
    # every group meets every query: all rows against the stated queries, in blocks
    copied = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("side"), "id", "v"
    )
    together = dealt.unionByName(copied).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "side", "id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        together.mapInArrow(_searcher(k, double), _FOUND)
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
