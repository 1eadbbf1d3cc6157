"""Hard negatives by an inverted multi-index.

Components become integers, so scores are exact.  Each half of the vectors has a
codebook, fitted to a bounded sample; a pair of codewords is a cell.  With ``r`` the
largest distance of a codeword's members from it, a half-score is at most
``a.c + |a| r``, and a cell's score at most the sum of its halves.  For an anchor the
codewords of either half are put in the order of those bounds, and a heap (the
multi-sequence walk) visits the cells by descending sum.  Positives are certain once the
next bound is below the k-th score found.  A window of negatives is certain once the
next bound is below the window or its k-th score; cells whose least score is above all
open windows are passed by.

Rows are dealt to groups of a bounded size by a hash, each an index of its own held by
one task; the anchors, the stated queries, are copied to every group and stream past it.
The lists of the groups are merged by rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import prepare, stored

#: Vectors the codebooks are fitted to (in the order of a hash of the id), and rounds.
SAMPLE, ROUNDS = 4096, 8
#: Components of a group, about as many rows to a cell, codewords of a half at most.
GROUP_COMPONENTS, CELL_ROWS, MOST_CODEWORDS = 1 << 20, 128, 32
#: Relative allowance for rounding in the bounds.
SLACK = 1e-9

_FOUND = T.StructType(
    [
        T.StructField("anchor_id", T.LongType()), T.StructField("p", T.IntegerType()),
        T.StructField("id", T.LongType()), T.StructField("score", T.LongType()),
    ]
)


def codebook(x: np.ndarray, size: int) -> np.ndarray:
    """Centres of at most ``size`` clusters of the rows, by Lloyd's rounds."""
    centres = np.unique(x[: 4 * size], axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(size, len(centres))).astype(int)]
    for _ in range(ROUNDS):
        near = nearest_centre(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def codebooks(sample: list[tuple[int, list[int]]], rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Both halves' codebooks for each dimension, for groups of so many rows."""
    by_dim: dict[int, list] = {}
    for _, codes in sample:
        by_dim.setdefault(len(codes), []).append(codes)
    size = int(np.clip(np.sqrt(rows / CELL_ROWS), 1, MOST_CODEWORDS))
    found = {}
    for dim, vectors in by_dim.items():
        x = np.array(vectors, dtype=np.float64)
        found[dim] = codebook(x[:, : dim // 2], size), codebook(x[:, dim // 2 :], size)
    return found


class Cells:
    """The vectors of one dimension of a group, cell by cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, codes: np.ndarray, books) -> None:
        half = codes.shape[1] // 2
        # a dimension that the sample does not hold is one cell
        self.books = books or (np.zeros((1, half)), np.zeros((1, codes.shape[1] - half)))
        x = codes.astype(np.float64)
        sides = x[:, :half], x[:, half:]
        near = [nearest_centre(s, b) for s, b in zip(sides, self.books, strict=True)]
        self.radii = []
        for s, b, c in zip(sides, self.books, near, strict=True):
            radius = np.zeros(len(b))
            np.maximum.at(radius, c, np.sqrt(((s - b[c]) ** 2).sum(axis=1)))
            self.radii.append(radius)
        width = len(self.books[1])
        cell = near[0] * width + near[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels = ids[order], labels[order]
        self.exact = float(np.abs(codes).max(initial=0)) ** 2 * codes.shape[1]
        self.floats, self.integers = x[order], codes[order] if self.exact >= 2**53 else None
        self.starts = np.searchsorted(cell[order], np.arange(len(self.books[0]) * width + 1)).tolist()

    def scores(self, anchor: np.ndarray, a: int, b: int) -> np.ndarray:
        """Inner products with the rows a..b, exactly."""
        if self.integers is None and float(np.abs(anchor).max(initial=0)) ** 2 * len(anchor) < 2**53:
            return (self.floats[a:b] @ anchor.astype(np.float64)).astype(np.int64)
        rows = self.floats[a:b].astype(np.int64) if self.integers is None else self.integers[a:b]
        return rows.astype(np.int64) @ anchor.astype(np.int64)

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(highest, lowest, a, b): bounds and rows of the cells, by descending highest."""
        a = anchor.astype(np.float64)
        half = len(a) // 2
        highest, lowest, order = [], [], []
        for side, book, radius in zip((a[:half], a[half:]), self.books, self.radii, strict=True):
            near = book @ side
            norm = np.sqrt((side * side).sum())
            reach = norm * radius + SLACK * norm * (np.sqrt((book * book).sum(axis=1)) + radius)
            rank = np.argsort(-(near + reach), kind="stable")
            highest.append((near + reach)[rank].tolist())
            lowest.append((near - reach)[rank].tolist())
            order.append(rank.tolist())
        (first, second), (low_1, low_2), (code_1, code_2) = highest, lowest, order
        width, starts = len(second), self.starts
        heap = [(-(first[0] + second[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < width:
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):  # the first of each row of cells opens the next
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
            cell = code_1[i] * width + code_2[j]
            if starts[cell] < starts[cell + 1]:
                yield -bound, low_1[i] + low_2[j], starts[cell], starts[cell + 1]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def best_positives(cells: Cells, own: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best other rows of the label."""
    ids = scores = np.zeros(0, dtype=np.int64)
    for bound, _, a, b in cells.walk(anchor):
        if len(scores) == k and bound < scores[-1]:
            break
        same = (cells.labels[a:b] == label) & (cells.ids[a:b] != own)
        if same.any():
            found = cells.scores(anchor, a, b)[same]
            ids, scores = _best(
                np.concatenate([ids, cells.ids[a:b][same]]), np.concatenate([scores, found]), k
            )
    return ids, scores


def best_in_windows(
    cells: Cells, own: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least, most) the k best rows of other labels with a score in it."""
    none = np.zeros(0, dtype=np.int64)
    found = [(none, none) for _ in windows]
    active = [w for w, (least, most) in enumerate(windows) if least <= most]
    for bound, low, a, b in cells.walk(anchor):
        floor = {w: int(found[w][1][-1]) if len(found[w][1]) == k else windows[w][0] for w in active}
        active = [w for w in active if bound >= floor[w]]
        if not active:
            break
        if low > max(windows[w][1] for w in active):
            continue
        scores = cells.scores(anchor, a, b)
        usable = (cells.labels[a:b] != label) & (cells.ids[a:b] != own)
        usable &= scores >= min(floor[w] for w in active)
        if not usable.any():
            continue
        ids, scores = cells.ids[a:b][usable], scores[usable]
        for w in active:
            fits = (scores >= floor[w]) & (scores <= windows[w][1])
            if fits.any():
                i, s = found[w]
                found[w] = _best(np.concatenate([i, ids[fits]]), np.concatenate([s, scores[fits]]), k)
    return found


class _Group:
    """Collects a group's rows, equal ones once, then answers anchors."""

    def __init__(self, books) -> None:
        self.books, self.parts, self.cells, self.held = books, {}, None, 0

    def add(self, ids: np.ndarray, labels: np.ndarray, lists: pa.ListArray) -> None:
        dims = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        starts = np.cumsum(dims) - dims
        for dim in set(dims.tolist()):
            at = np.flatnonzero(dims == dim)
            codes = flat[starts[at, None] + np.arange(dim)]
            self.parts.setdefault(dim, []).append(np.column_stack([ids[at], labels[at], codes]))
        self.held += len(flat)
        if self.held > 4 * GROUP_COMPONENTS:  # many equal rows: no group is so large otherwise
            self._merge()
            self.held = 0

    def _merge(self) -> None:
        self.parts = {d: [np.unique(np.concatenate(p), axis=0)] for d, p in self.parts.items()}

    def index(self, dim: int) -> Cells | None:
        if self.cells is None:
            self._merge()
            self.cells = {
                d: Cells(p[:, 0], p[:, 1], p[:, 2:].astype(np.int32), self.books.get(d))
                for d, (p,) in self.parts.items()
            }
            self.parts = {}
        return self.cells.get(dim)


def _searcher(shared, k: int, least: int, most: int):
    """Search each group for the anchors that follow its rows; windows given or none."""

    def answers(group: _Group, batch: pa.RecordBatch) -> list[tuple]:
        rows = []
        for row in batch.to_pylist():
            cells = group.index(len(row["codes"]))
            if cells is None:
                continue
            anchor = np.array(row["codes"], dtype=np.int64)
            if row["windows"] is None:
                ids, scores = best_positives(cells, row["id"], row["label"], anchor, k)
                rows += [(row["id"], None, int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
                continue
            bounds = [(-(-least * w["score"] // 100), most * w["score"] // 100) for w in row["windows"]]
            found = best_in_windows(cells, row["id"], row["label"], anchor, bounds, k)
            for w, (ids, scores) in zip(row["windows"], found, strict=True):
                rows += [(row["id"], w["p"], int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = None, None
        for batch in batches:
            g, kind = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if stop == start:
                    continue
                part = batch.slice(start, stop - start)
                if g[start] != at:
                    group, at = _Group(shared.value), g[start]
                if kind[start] == 0:
                    group.add(part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4))
                elif found := answers(group, part):
                    columns = zip(*found, strict=True)
                    types = pa.int64(), pa.int32(), pa.int64(), pa.int64()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_FOUND.fieldNames()
                    )

    return run


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, scale: int = 256,
    least: int = 50, most: int = 95, key: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as ``floor(scale * x)``.  An anchor's positives are its best other
    rows of its label; for each, the best rows of other labels whose score lies between
    ``least`` and ``most`` per cent of the positive's.  Ties go to the smaller id.

    Rows without an id or a label, with a null or empty vector or with a component that is
    null or not finite take no part, nor do those that could make a score of 62 bits.
    Only vectors of the anchor's dimension are candidates, none of its own id.  Of an id's
    repeated rows equal ones count once; if they differ, all are candidates and the
    smallest (label, then components) is the anchor.  Other columns are left out.  An
    empty table, or anchors without positives or negatives, give no rows.
    """
    spark = prepare(vectors.sparkSession)
    size = F.lit(float(scale))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    largest = F.array_max(F.transform("v", lambda x: F.abs(F.floor(size * x).cast("double"))))
    named = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("v"), is_anchor.alias("is_anchor"),
    )
    kept = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite
    # checked in this order: floor() of a component beyond 64 bits would fail
    bounded = F.forall("v", lambda x: F.abs(x) < F.lit(2.0**31 / scale))
    rows = named.where(F.when(kept, F.when(bounded, largest * largest * F.size("v") < 2.0**62))).select(
        "id", "label", F.transform("v", lambda x: F.floor(size * x).cast("int")).alias("codes"), "is_anchor"
    )
    n, components = rows.agg(F.count(F.lit(1)), F.sum(F.size("codes"))).first()
    groups = max(1, -(-(components or 0) // GROUP_COMPONENTS))
    sample = rows.select("id", "codes").orderBy(F.xxhash64("id"), "id", "codes").limit(SAMPLE).collect()
    shared = spark.sparkContext.broadcast(codebooks([(r.id, r.codes) for r in sample], -(-n // groups)))
    none = F.lit(None).cast("array<struct<p:int,score:long>>")
    dealt = rows.select(
        F.pmod(F.xxhash64("id", "codes"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"),
        "id", "label", "codes", none.alias("windows"),
    )
    anchors = stored(
        rows.where("is_anchor").groupBy("id").agg(F.min(F.struct("label", "codes")).alias("a"))
        .select("id", "a.label", "a.codes"), "anchors",
    )

    def search(asked: DataFrame, k: int) -> DataFrame:
        # every group meets every anchor: all rows against the stated queries, in blocks
        copied = asked.select(
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"),
            "id", "label", "codes", "windows",
        )
        together = dealt.unionByName(copied).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind")
        return together.mapInArrow(_searcher(shared, k, least, most), _FOUND)

    order = F.desc("score"), F.asc("id")
    by_anchor = Window.partitionBy("anchor_id").orderBy(*order)
    best = stored(
        search(anchors.withColumn("windows", none), positives)
        .withColumn("p", F.row_number().over(by_anchor)).where(F.col("p") <= positives), "positives",
    )
    asked = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("p", "score")).alias("windows"))
    by_positive = Window.partitionBy("anchor_id", "p").orderBy(*order)
    hard = (
        search(anchors.join(asked, "id"), negatives)
        .withColumn("rank", F.row_number().over(by_positive)).where(F.col("rank") <= negatives)
    )
    return hard.alias("n").join(best.alias("b"), ["anchor_id", "p"]).select(
        "anchor_id", F.col("b.id").alias("positive_id"), "rank", F.col("n.id").alias("negative_id"),
        F.col("b.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
