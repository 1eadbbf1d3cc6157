"""Token ids in files: frequency-ranked, byte-aligned, with control bytes apart.

Ids are replaced by their rank in the corpus (0 is the most frequent, ties to the
smaller id), so common ids take one byte.  A block holds the ranks of consecutive
documents in stream-variable-byte coding: first one control byte for every four
ranks, two bits each giving the bytes of a rank less one, then the data bytes,
little endian.  Numpy decodes it by table lookup: a control byte names the four
lengths, their running sum the places.

A token table is a folder with two Parquet tables: ``blocks`` (shard, block,
before, keys, sizes, payload) in ascending key order by (shard, block), and
``ranks`` (rank, id).  ``before`` counts the ids of earlier blocks of the shard;
there are as many shards as shuffle partitions, so their totals are small.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import cut, prepare
from tidemark.llm.token_counts import pretokens
from tidemark.session import scratch_path

#: Ids of a block; a longer document makes a block of its own.
BLOCK_IDS = 1 << 18
_MAGIC = b"TIDV1\0\0\0"

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(values: np.ndarray) -> bytes:
    """Header, control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    n = len(values)
    padded = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    longer = [np.flatnonzero(values >= 1 << 8 * k) for k in (1, 2, 3)]
    for more in longer:
        padded[more] += 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    places = np.arange(n) + np.cumsum(padded[:n], dtype=np.int64) - padded[:n]
    data = np.empty(n + sum(map(len, longer)), dtype=np.uint8)
    data[places] = values & 0xFF
    for k, more in enumerate(longer, 1):
        data[places[more] + k] = values[more] >> np.uint32(8 * k) & 0xFF
    return _MAGIC + struct.pack("<q", n) + control.astype(np.uint8).tobytes() + data.tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """The values that :func:`pack` wrote."""
    if payload[:8] != _MAGIC:
        raise ValueError("not a block of token ids")
    (n,) = struct.unpack_from("<q", payload, 8)
    controls = -(-n // 4)
    sizes = _LENGTHS[np.frombuffer(payload, np.uint8, controls, 16)].ravel()[:n]
    data = np.frombuffer(payload, np.uint8, -1, 16 + controls)
    places = np.cumsum(sizes) - sizes
    out = data[places].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(sizes > k)
        out[longer] |= data[places[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _raw_schema(key: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("before", T.LongType()),
            T.StructField("keys", T.ArrayType(key)),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )


def tokenized(docs: DataFrame, path: str, key: str, text: str, end_id: int) -> DataFrame:
    """Blocks of raw little-endian ids in key order, each document ended by ``end_id``."""
    prepare(docs.sparkSession)
    schema = _raw_schema(docs.schema[key].dataType)
    arrow = to_arrow_schema(schema)
    # equal keys are told apart by their text, so that they can be split as well
    ordered = (
        docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
        .repartitionByRange("key", F.xxhash64("text"))
        .sortWithinPartitions("key", F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard = pretokens(path, with_ids=True), TaskContext.get().partitionId()
        block, before, held, keys, sizes, ids = 0, 0, 0, [], [], []

        def flush():
            nonlocal block, before, held, keys, sizes, ids
            payload = np.concatenate(ids).astype("<u4").tobytes()
            row = [shard], [block], [before], [keys], [sizes], [payload]
            made = [pa.array(x, type=f.type) for x, f in zip(row, arrow, strict=True)]
            block, before = block + 1, before + held
            held, keys, sizes, ids = 0, [], [], []
            return pa.RecordBatch.from_arrays(made, schema=arrow)

        for batch in batches:
            for part in cut(batch, 1, 1 << 20):
                flat, n = table.encoded(part.column(1).to_pylist())
                at = np.cumsum(n) - n
                end = np.array([end_id], dtype=np.uint32)
                for k, start, size in zip(part.column(0).to_pylist(), at, n, strict=True):
                    keys.append(k)
                    sizes.append(int(size) + 1)
                    ids += [flat[start : start + size], end]
                    held += int(size) + 1
                    if held >= BLOCK_IDS:
                        yield flush()
        if keys:
            yield flush()

    return ordered.mapInArrow(run, schema)


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            found = np.bincount(np.frombuffer(payload, "<u4"))
            if len(found) > len(total):
                found, total = total, found.astype(np.int64)
            total[: len(found)] += found
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])


def write(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id",
          text: str = "text") -> str:
    """Write the token table of all texts below ``folder`` and return ``folder``.

    A null text is empty; a null key sorts first; rows of one key keep together,
    in the order of a hash of their text.  An empty table gives empty files.
    """
    spark = docs.sparkSession
    raw_path = scratch_path(spark, "raw-ids")
    tokenized(docs, path, key, text, end_id).write.parquet(raw_path)
    raw = spark.read.schema(_raw_schema(docs.schema[key].dataType)).parquet(raw_path)
    ranks = (
        raw.select("payload").mapInArrow(_count_ids, "id long, n long")
        .groupBy("id").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "id").select("id")
    )
    ids = np.array([r[0] for r in ranks.collect()], dtype=np.int64)  # at most the vocabulary
    spark.createDataFrame(
        [(i, int(x)) for i, x in enumerate(ids)], "rank long, id long"
    ).coalesce(1).write.parquet(f"{folder}/ranks")
    to_rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint32)
    to_rank[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(to_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("payload")
            packed = [
                pack(shared.value[np.frombuffer(p, "<u4")]) for p in batch.column(at).to_pylist()
            ]
            yield batch.set_column(at, batch.schema.field(at), pa.array(packed, pa.binary()))

    raw.mapInArrow(run, raw.schema).write.parquet(f"{folder}/blocks")
    return folder


def read(spark: SparkSession, folder: str, key: T.DataType, each, outputs: T.StructType) -> DataFrame:
    """Rows (key, start, n_tokens, outputs) of every document of a token table.

    ``each`` turns the unsigned 32-bit ids of one document into one tuple of output
    values.  ``start`` counts the ids of all documents before it.
    """
    prepare(spark)
    blocks = spark.read.schema(_raw_schema(key)).parquet(f"{folder}/blocks")
    ranks = spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").orderBy("rank")
    ids = np.array([r.id for r in ranks.collect()], dtype=np.uint32)  # at most the vocabulary
    totals = (
        blocks.groupBy("shard")
        .agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
        .orderBy("shard").collect()  # a row for each shuffle partition
    )
    ends = np.cumsum([r.n for r in totals], dtype=np.int64)
    first = {r.shard: int(e - r.n) for r, e in zip(totals, ends, strict=True)}
    shared = spark.sparkContext.broadcast((ids, first))
    schema = T.StructType(
        [
            T.StructField("key", key), T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()), *outputs.fields,
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, firsts = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                found = names[unpack(row["payload"])]
                sizes = np.array(row["sizes"], dtype=np.int64)
                local = np.cumsum(sizes) - sizes
                made = [each(found[a : a + n]) for a, n in zip(local, sizes, strict=True)]
                columns = [row["keys"], firsts[row["shard"]] + row["before"] + local, sizes]
                columns += list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)],
                    schema=arrow,
                )

    return blocks.mapInArrow(run, schema)


def checksum(ids: np.ndarray) -> tuple[int]:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
