"""Near-duplicate texts: a Jaccard join of word n-grams as a sparse product.

Rows are distinct shingle sets, columns are shingles.  Two sets link when
``100 * overlap >= 80 * union``, which needs ``9 * overlap >= 4 * (m + n)`` of
their sizes.  Multiplying the whole incidence matrix with its transpose is
neither possible nor needed:

* A sketch of fixed size counts all shingles of all texts.  Each set is put in
  order of those counts, rarest first.  (Any common order is exact; a good one is
  fast.)  Sets of sizes ``m <= n`` that link share a shingle among the first
  ``m - ceil(8m/9) + 1`` of the smaller and ``n - ceil(4n/5) + 1`` of the larger,
  so only those columns are multiplied.
* The product is accumulated by column blocks (a shuffle on the shingle).  A pair
  goes on only if its overlap so far, plus what can follow the last shared
  position in either set, can reach its bound.
* The overlap of what is left is counted exactly, in blocks of rows, from the
  whole sets.

Components are asked for, not all pairs.  First each set meets one partner, the
most central that shares one of its ``STAR_COLUMNS`` columns; what links is joined
to components.  Then all pairs of different components are multiplied, where in each
column the rows outside its largest component meet all others.  So a group of
copies costs about its size, and no link between two components is missed.  For
that product a set has a bitmap with the parity of its shingles per bit: bits that
differ are a lower bound on ``m + n - 2 * overlap``, which at a link is at most
``(m + n) / 9``.

Texts with equal sets are one row from the start.  A set is named by a 64-bit
hash, as is a shingle; among *n* sets two share a name with chance ``n**2 / 2**65``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import cut, kept, prepare, ranges, stored, tidy

WORDS = 5
#: Fixed size of the count sketch: counters, and counters in one of its rows.
COUNTERS, CHUNK = 1 << 22, 1 << 18
#: Words whose hash a process remembers.
CACHE = 100_000
#: Columns of a row that the first product uses: those of smallest hash.
STAR_COLUMNS = 8
#: Longs of 64 parity bits that bound how much two sets differ.
BIT_LONGS = 8
#: Sets sent to every executor to pick their texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
     0x27D4EB2F165667C5], dtype=np.uint64,
)  # odd constants without meaning


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words are runs without ASCII white space, A-Z lower-cased.  A text of fewer than
    ``WORDS`` words is one shingle, a text without words none.
    """
    hashes = kept(__name__, "words", _Hashes)
    out = []
    for text in texts:
        words = (text or b"").lower().split()
        n = len(words)
        a = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
        if n >= WORDS:
            h = a[: n - WORDS + 1] * _FACTORS[0]
            for k in range(1, WORDS):
                h = (h ^ (h >> np.uint64(29))) + a[k : n - WORDS + 1 + k] * _FACTORS[k]
            out.append(np.unique(_mix(h)))
        elif n:
            h = np.array([n], dtype=np.uint64)
            for k in range(n):
                h = (h ^ (h >> np.uint64(29))) + a[k : k + 1] * _FACTORS[k]
            out.append(_mix(h))
        else:
            out.append(a)
    return out


def name_of(hashes: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """``BIT_LONGS`` signed longs: for each bit the parity of the shingles on it."""
    low = (hashes & np.uint64(64 * BIT_LONGS - 1)).astype(np.int64)
    odd = np.bincount(low, minlength=64 * BIT_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _column(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, mark, n, ref, bits) of each text, then this task's part of the sketch."""
    counts, key_type = np.zeros(COUNTERS, dtype=np.uint32), None
    seen: set[int] = set()
    bits = pa.list_(pa.int64())
    for batch in batches:
        for part in cut(batch, 2):
            sets = shingle_sets(part.column(2).to_pylist())
            refs = [name_of(s) for s in sets]
            for s, r in zip(sets, refs, strict=True):
                if r not in seen:
                    seen.add(r)
                    np.add.at(counts, _column(s), 1)
            n, key_type = part.num_rows, part.schema.field(0).type
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(list(map(len, sets)), pa.int64()),
                 pa.array(refs, pa.int64()), pa.array([parities(s) for s in sets], bits),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["key", "mark", "n", "ref", "bits", "chunk", "counts"],
            )
    if key_type is not None:
        yield _sketch_rows({k: counts[k * CHUNK : (k + 1) * CHUNK] for k in range(COUNTERS // CHUNK)},
                           key_type)


def _sketch_rows(chunks: dict[int, np.ndarray], key_type=None) -> pa.RecordBatch:
    data = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in chunks.values()]
    columns = [pa.array(list(chunks), pa.int32()), pa.array(data, pa.binary())]
    names = ["chunk", "counts"]
    if key_type is not None:
        blank = [pa.nulls(len(data), t) for t in (
            key_type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
        columns, names = blank + columns, ["key", "mark", "n", "ref", "bits", *names]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _sum_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}  # COUNTERS counters at most
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(data), "<u4")
            total[chunk] = total[chunk] + part if chunk in total else part
    yield _sketch_rows(total)


def _levels(sketch: DataFrame) -> np.ndarray:
    """The sketch over all texts on a logarithmic scale, one byte a counter."""
    rows = sketch.repartition(32).mapInArrow(tidy(_sum_sketch), "chunk int, counts binary")
    rows = rows.repartition(COUNTERS // CHUNK, "chunk")
    rows = rows.mapInArrow(tidy(_sum_sketch), "chunk int, counts binary")
    out = np.zeros(COUNTERS, dtype=np.uint8)
    for r in rows.toLocalIterator():  # COUNTERS counters in all
        counts = np.frombuffer(zlib.decompress(r.counts), "<u4").astype(np.float64)
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.round(7 * np.log2(1 + counts))
    return out


def _postings(shared):
    """(h, ref, n, pos) of the columns that each distinct set can link by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = shared.value, set()
        for batch in batches:
            for part in cut(batch, 0):
                kept, refs, sizes, lengths = [], [], [], []
                for s in shingle_sets(part.column(0).to_pylist()):
                    n, ref = len(s), name_of(s)
                    if not n or ref in seen:
                        continue
                    seen.add(ref)
                    length = n - (4 * n + 4) // 5 + 1
                    kept.append(s[np.lexsort((s, levels[_column(s)]))[:length]])
                    refs.append(ref)
                    sizes.append(n)
                    lengths.append(length)
                if not kept:
                    continue
                lengths = np.array(lengths, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(kept).view(np.int64)),
                        pa.array(np.repeat(np.array(refs, dtype=np.int64), lengths)),
                        pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths)),
                        pa.array(ranges(np.zeros(len(lengths), dtype=np.int64), lengths).astype(np.int32)),
                    ],
                    names=["h", "ref", "n", "pos"],
                )

    return run


def _may_link(a: str, b: str) -> Column:
    """Column pair (a, b): a the smaller set, sizes fit, and a's column is in its short prefix.

    Sizes and positions of this one column bound the overlap already.
    """
    na, nb, pa_, pb = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (a, b))
    first = (na < nb) | ((na == nb) & (F.col(f"{a}.ref") < F.col(f"{b}.ref")))
    return (
        first & (5 * na >= 4 * nb) & (pa_ < na - F.floor((8 * na + 8) / 9) + 1)
        & (9 * (F.least(pa_, pb) + F.least(na - pa_, nb - pb)) >= 4 * (na + nb))
    )


def _may_differ(a: str, b: str) -> Column:
    """Whether the bitmaps of two rows differ in few enough bits for a link."""
    bits = F.lit(0)
    for k in range(BIT_LONGS):
        bits = bits + F.bit_count(F.col(f"{a}.bits{k}").bitwiseXOR(F.col(f"{b}.bits{k}")))
    return 9 * bits <= F.col(f"{a}.n") + F.col(f"{b}.n")


def _accumulate(columns: DataFrame) -> DataFrame:
    """Pairs (a, b) whose overlap in prefix columns still allows a link.

    ``columns`` has a row (a, na, pos_a, b, nb, pos_b) for each shared column.
    """
    na, nb = F.col("na"), F.col("nb")
    possible = F.col("shared") + F.least(na - F.col("last_a") - 1, nb - F.col("last_b") - 1)
    return (
        columns.groupBy("a", "na", "b", "nb")
        .agg(F.count("*").alias("shared"), F.max("pos_a").alias("last_a"), F.max("pos_b").alias("last_b"))
        .where(9 * possible >= 4 * (na + nb)).select("a", "na", "b", "nb")
    )


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep (a, b) whose sets overlap enough; a block of rows is multiplied at once."""
    for batch in batches:
        for part in cut(batch, 2):
            left, right = (part.column(i).to_pylist() for i in (2, 3))
            m, n = (np.array([len(x) // 8 for x in side], dtype=np.int64) for side in (left, right))
            rows = np.concatenate([np.repeat(np.arange(len(m)), m), np.repeat(np.arange(len(n)), n)])
            columns = np.frombuffer(b"".join([*left, *right]), dtype=np.uint64)
            order = np.lexsort((columns, rows))
            rows, columns = rows[order], columns[order]
            same = (rows[1:] == rows[:-1]) & (columns[1:] == columns[:-1])
            overlap = np.bincount(rows[1:][same], minlength=len(m))
            linked = pa.array(100 * overlap >= 80 * (m + n - overlap))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(linked), part.column(1).filter(linked)], names=["a", "b"]
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in cut(batch, 1, 1 << 20):
            wanted = part.column(0).to_pylist()
            sets = shingle_sets(part.column(1).to_pylist())
            right = [k for k, s in enumerate(sets) if name_of(s) == wanted[k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([wanted[k] for k in right], pa.int64()),
                 pa.array([sets[k].tobytes() for k in right], pa.binary())],
                names=["ref", "hashes"],
            )


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of sets that link, from whole texts."""
    refs = pairs.select(F.col("a").alias("ref")).union(pairs.select("b")).distinct()
    wanted = stored(classes.join(refs, "ref", "left_semi").select("ref", "key"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = texts.join(wanted, "key").select("ref", "text").mapInArrow(tidy(_sets), "ref long, hashes binary")
    sets = stored(sets.dropDuplicates(["ref"]), "sets")
    both = (
        pairs.join(sets.select(F.col("ref").alias("a"), F.col("hashes").alias("ha")), "a")
        .join(sets.select(F.col("ref").alias("b"), F.col("hashes").alias("hb")), "b")
        .select("a", "b", "ha", "hb")
    )
    return stored(both.mapInArrow(tidy(_overlaps), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is its smallest node.

    Alternating large-star and small-star steps: each replaces the neighbours of a
    node by its smallest one, until only stars are left.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        .where("x != y").distinct(), "edges",
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first()
        if state == before:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).union(
                edges.select("y", "y").distinct()
            )
        before = state
        both = edges.union(edges.select("y", "x"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges = stored(small.union(least).distinct(), "edges")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, n, root, component) of every row; ``mark`` is a hash of its text."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(
        F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("mark"),
        F.col(text).cast("string").cast("binary").alias("text"),
    )
    survey = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType), T.StructField("mark", T.LongType()),
            T.StructField("n", T.LongType()), T.StructField("ref", T.LongType()),
            T.StructField("bits", T.ArrayType(T.LongType())),
            T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType()),
        ]
    )
    seen = stored(texts.mapInArrow(tidy(_survey), survey), "survey")
    sketch = seen.where("chunk is not null").select("chunk", "counts")
    levels = spark.sparkContext.broadcast(_levels(sketch))  # COUNTERS bytes
    rows = seen.where("chunk is null").select("key", "mark", "n", "ref")
    linkable = F.col("key").isNotNull() & (F.col("n") > 0)
    one = seen.where("chunk is null").where(linkable).groupBy("ref")
    classes = stored(
        one.agg(F.min("key").alias("key"), F.any_value("bits").alias("bits")), "classes"
    )
    links = _links(texts.where(F.col("key").isNotNull()).select("key", "text"), classes, levels)

    named = classes.drop("bits").join(components(links).withColumnRenamed("node", "ref"), "ref", "left")
    named = named.withColumn("root", F.coalesce("root", "ref"))
    least = named.groupBy("root").agg(F.min("key").alias("component"))
    named = named.join(least, "root").select("ref", "root", "component")
    alone = rows.where(~linkable)
    return (
        rows.where(linkable).join(named, "ref", "left")
        .select("key", "mark", "n", "root", "component")
        .union(alone.select("key", "mark", "n", F.lit(None).cast("long"), "key"))
    )


def _links(texts: DataFrame, classes: DataFrame, levels) -> DataFrame:
    """Links (a, b) between sets that join the same components as all links do."""
    postings = stored(
        texts.select("text").mapInArrow(tidy(_postings(levels)), "h long, ref long, n int, pos int"),
        "postings",
    )
    common = postings.groupBy("h").count().where("count > 1").select("h")
    live = stored(postings.join(common, "h", "left_semi").distinct(), "live")

    # first product: every row with the most central row of its columns.  A set with
    # shingles of its own has them in its prefix, where no other set has them, so the
    # share of prefix columns in use tells the middle of a group from its edge.
    prefix = F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1
    used = live.groupBy("ref", "n").count().select("ref", (-F.col("count") / prefix).alias("edge"))
    known = live.join(used, "ref")
    pivot = (
        known.groupBy("h").agg(F.min(F.struct("edge", "n", "ref", "pos")).alias("p"))
        .select("h", "p.*").alias("p")
    )
    first = Window.partitionBy("ref").orderBy("h")
    few = live.withColumn("_at", F.row_number().over(first)).where(f"_at <= {STAR_COLUMNS}")
    met = few.alias("l").join(pivot, F.col("l.h") == F.col("p.h")).where(
        _may_link("p", "l") | _may_link("l", "p")
    )
    star = (
        met.groupBy(F.col("l.ref").alias("ref"), F.col("l.n").alias("n"))
        .agg(F.min(F.struct("edge", F.col("p.ref").alias("to"), F.col("p.n").alias("size"))).alias("s"))
    )
    own, other = F.struct("n", "ref"), F.struct(F.col("s.size").alias("n"), F.col("s.to").alias("ref"))
    star = star.select(F.least(own, other).alias("a"), F.greatest(own, other).alias("b")).select(
        F.col("a.ref").alias("a"), F.col("b.ref").alias("b")
    )
    star = stored(star.distinct(), "star")
    links = _linked(star, classes, texts)
    roots = components(links).withColumnRenamed("node", "ref")

    # second product: rows of different components
    marked = live.join(roots, "ref", "left").withColumn("c", F.coalesce("root", "ref")).drop("root")
    marked = stored(marked, "marked")
    split = marked.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    largest = (
        marked.join(split, "h", "left_semi").groupBy("h", "c").count()
        .groupBy("h").agg(F.max_by("c", F.struct("count", "c")).alias("most"))
    )
    unpacked = [F.col("bits")[k].alias(f"bits{k}") for k in range(BIT_LONGS)]
    mixed = marked.join(largest, "h").join(classes.select("ref", *unpacked), "ref")
    mixed = stored(mixed, "mixed")
    pairs = mixed.where("c != most").alias("l").join(
        mixed.alias("r"),
        (F.col("l.h") == F.col("r.h")) & (F.col("l.c") != F.col("r.c")) & _may_differ("l", "r"),
    )
    # two rows outside the largest component meet twice; l is the smaller once
    inside = F.col("r.c") == F.col("r.most")
    columns = [
        pairs.where(met_by).select(
            F.col(f"{s}.ref").alias("a"), F.col(f"{s}.n").alias("na"), F.col(f"{s}.pos").alias("pos_a"),
            F.col(f"{g}.ref").alias("b"), F.col(f"{g}.n").alias("nb"), F.col(f"{g}.pos").alias("pos_b"),
        )
        for s, g, met_by in (("l", "r", _may_link("l", "r")), ("r", "l", _may_link("r", "l") & inside))
    ]
    rest = _accumulate(columns[0].union(columns[1])).join(star, ["a", "b"], "left_anti")
    return links.union(_linked(stored(rest, "rest"), classes, texts))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``group_ref`` of every row.

    ``component_id`` is the smallest key that links lead to, itself included;
    ``group_ref`` names the component also where keys repeat.  A null text or one
    without words has no shingles and links with nothing; its ``group_ref`` is null.
    A row with a null key links with nothing and has a null ``component_id``.  Rows
    that repeat a key count as documents of their own.
    """
    return grouped(docs, key, text).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"), F.col("root").alias("group_ref"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, unchanged, without near duplicates: of each group one row stays.

    It is the one with the smallest key; of rows with that key the one whose text
    has the smallest hash, of repeated rows any one.  Rows without words or without
    a key are no duplicates and stay.
    """
    names = docs.columns
    found = grouped(docs, key, text).where(F.col("root").isNotNull())
    first = found.groupBy("root").agg(F.min(F.struct("key", "mark")).alias("f"))
    first = first.select(F.col("f.key").alias("__key"), F.col("f.mark").alias("__mark"))
    blank = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r ", "") == ""
    free = F.col(key).isNull() | blank
    marked = docs.withColumn("__own", F.xxhash64(F.col(text).cast("string")))
    rows = marked.where(~free).join(
        first, (F.col(key) == F.col("__key")) & (F.col("__own") == F.col("__mark"))
    )
    order = Window.partitionBy("__key", "__mark").orderBy(F.lit(1))
    single = rows.withColumn("__row", F.row_number().over(order)).where("__row = 1")
    return single.select(names).union(docs.where(free).select(names))
