"""A Merkle manifest of a dataset: leaves, group roots, proofs and their folding.

Rows become leaves; the leaves of a group stand in the order of their ids.  No rows are
sorted for that.  Each group has a compressed bitmap of its ids: the 64-bit words that
are not zero, built in every task for its own rows and merged by OR, and a directory of
popcounts, summed 15 bits of the word number at a time.  The rank of an id (popcount
before its word, plus the bits below it) is its leaf's place.

Place ``p`` lies in slot ``p mod 4096`` of the array keyed ``p div 4096``.  An array is
four levels of the tree, so a round that fills and reduces the arrays leaves one node for
4096; rounds go on until a group has one node, its subroot.  The subroots are leaves of a
last tree.  Then paths go down: an array gets the siblings above it once, not once for
each leaf, and adds those inside it.

Digests are hexadecimal text when hashed, and 32 bytes when stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import prepare, stored
from tidemark.operators.dedupe import with_surrogate_key

#: Children of a node, levels in an array, and the slots that makes.
FAN_BITS, LEVELS = 3, 4
FAN, SLOTS = 1 << FAN_BITS, 1 << FAN_BITS * LEVELS
#: Ids in a word of a bitmap and words (or sums) below one sum of the directory, in bits.
WORD_BITS, DIRECTORY_BITS = 6, 15
#: The word of a null id, before those of all 64-bit ids.
NULL_WORD = -(1 << 58)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_ARRAYS = T.StructType(
    [
        T.StructField("grp", T.StringType()), T.StructField("chunk", T.LongType()),
        T.StructField("total", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("nodes", T.BinaryType()), T.StructField("changed", T.BinaryType()),
        T.StructField("digest", T.BinaryType()),
    ]
)
_PATHS = T.StructType(
    [T.StructField("grp", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("path", T.BinaryType())]
)
_PROOFS = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("leaf", T.StringType()),
        T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()),
        T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType()),
        T.StructField("verified", T.BooleanType()),
    ]
)


def leaf_hash(values: list[Column]) -> Column:
    """Hex sha256 of values, each as ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    coded = [
        F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
        for v in values
    ]
    return F.sha2(F.concat(*coded), 256)


# ---- places by rank in bitmaps


def _word(key: str) -> Column:
    return F.coalesce(F.shiftright(key, WORD_BITS), F.lit(NULL_WORD))


def bitmap_words(rows: DataFrame, key: str = "id") -> DataFrame:
    """(grp, word, bits, n): the words of each group's bitmap and how many rows each covers."""
    bit = F.expr(f"shiftleft(1L, cast(coalesce({key} & {(1 << WORD_BITS) - 1}, 0) as int))")
    return rows.groupBy("grp", _word(key).alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n")
    )


def popcount_directory(words: DataFrame, at: str = "word", bits: int = 64 - WORD_BITS + 1) -> DataFrame:
    """(grp, at, start): the rows of a group before each word.

    A window covers the words below one sum of the next level only, never a whole group,
    unless so few bits of the word number are left that a group is as small.
    """
    up = f"{at}_up"
    shifted = F.shiftright(at, DIRECTORY_BITS) if bits > DIRECTORY_BITS else F.lit(0).cast("long")
    before = Window.partitionBy("grp", up).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    local = words.select("grp", at, shifted.alias(up), "n").withColumn(
        "inner", F.coalesce(F.sum("n").over(before), F.lit(0))
    )
    if bits <= DIRECTORY_BITS:
        return local.select("grp", at, F.col("inner").alias("start"))
    sums = words.groupBy("grp", shifted.alias(up)).agg(F.sum("n").alias("n"))
    above = popcount_directory(sums, up, bits - DIRECTORY_BITS)
    return local.join(above, ["grp", up]).select("grp", at, (F.col("start") + F.col("inner")).alias("start"))


def places(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` (grp, id, leaf, changed) with ``place``, the rank of the id in its group.

    Words that cover more rows than ids hold repeated ids: their rows are counted by
    content, and a running count over the different ones in the order of id and leaf
    takes the bits' part.
    """
    directory = words.join(popcount_directory(words), ["grp", "word"])
    keyed = rows.withColumn("word", _word("id"))
    single = F.col("n") == F.bit_count("bits")
    low = F.expr(f"bit_count(bits & ~shiftleft(-1L, cast(coalesce(id & {(1 << WORD_BITS) - 1}, 0) as int)))")
    plain = keyed.join(directory.where(single), ["grp", "word"]).select(*rows.columns, (F.col("start") + low).alias("place"))
    counted = (
        keyed.join(words.where(~single).select("grp", "word"), ["grp", "word"], "left_semi")
        .groupBy("grp", "word", "id", "leaf", "changed").agg(F.count(F.lit(1)).alias("copies"))
    )
    before = Window.partitionBy("grp", "word").orderBy("id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    repeated = (
        counted.withColumn("inner", F.coalesce(F.sum("copies").over(before), F.lit(0)))
        .join(directory.select("grp", "word", "start"), ["grp", "word"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select(*rows.columns, (F.col("start") + F.col("inner") + F.col("copy")).alias("place"))
    )
    return plain.unionByName(repeated)


# ---- arrays of slots


def reduced(nodes: list[bytes], total: int) -> list[list[bytes]]:
    """The levels of an array, from its nodes up, in a tree level of ``total`` nodes."""
    levels = [nodes]
    while total > 1 and len(levels) <= LEVELS:
        last = levels[-1]
        levels.append(
            [sha256(b"".join(last[i : i + FAN])).hexdigest().encode() for i in range(0, len(last), FAN)]
        )
        total = -(-total // FAN)
    return levels


def _hex(packed: bytes) -> list[bytes]:
    text = packed.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the items of each key into their slots and reduce the array."""
    arrow = to_arrow_schema(_ARRAYS)
    for batch in batches:
        for grp, chunk, total, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            slots: list = [None] * len(items)
            for item in items:
                slots[item["slot"]] = item
            nodes = b"".join(s["leaf"] for s in slots)
            changed = b"".join(s["changed"] or s["leaf"] for s in slots)
            digest = bytes.fromhex(reduced(_hex(nodes), total)[-1][0].decode())
            row = grp, chunk, total, [s["id"] for s in slots], nodes, changed, digest
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow
            )


def _arrays(nodes: DataFrame, label: str) -> DataFrame:
    """Slot arrays of nodes (grp, total, place, id, leaf, changed), stored."""
    keyed = nodes.groupBy("grp", F.shiftright("place", FAN_BITS * LEVELS).alias("chunk")).agg(
        F.max("total").alias("total"),
        F.collect_list(
            F.struct((F.col("place") % SLOTS).cast("int").alias("slot"), "id", "leaf", "changed")
        ).alias("items"),  # at most SLOTS, whatever the group
    )
    return stored(keyed.select("grp", "chunk", "total", "items").mapInArrow(_fill, _ARRAYS), label)


def _rounds(nodes: DataFrame, most: int, label: str) -> list[DataFrame]:
    """Arrays of each round, the last with one array for each group of at most ``most`` nodes."""
    done = [_arrays(nodes, label)]
    while most > SLOTS:
        most = -(-most // SLOTS)
        above = done[-1].select(
            "grp", F.ceil(F.col("total") / SLOTS).alias("total"), F.col("chunk").alias("place"),
            F.lit(None).cast("long").alias("id"), F.col("digest").alias("leaf"),
            F.lit(None).cast("binary").alias("changed"),
        )
        done.append(_arrays(above, label))
    return done


# ---- paths


def _steps(levels: list[list[bytes]], slot: int) -> list[tuple[list[bytes], int]]:
    """The run and the own place in it at each level above ``slot``."""
    out = []
    for level in levels[:-1]:
        first = slot & -FAN
        out.append((level[first : first + FAN], slot - first))
        slot >>= FAN_BITS
    return out


def _write_steps(steps: list[tuple[list[bytes], int]]) -> bytes:
    return b"".join(bytes([len(run), own]) + bytes.fromhex(b"".join(run).decode()) for run, own in steps)


def _read_steps(path: bytes) -> list[tuple[list[bytes], int]]:
    out, at = [], 0
    while at < len(path):
        size, own = path[at], path[at + 1]
        out.append((_hex(path[at + 2 : at + 2 + 32 * size]), own))
        at += 2 + 32 * size
    return out


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of every node of an array: the steps inside it, then the array's own."""
    for batch in batches:
        for grp, chunk, total, nodes, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            levels = reduced(_hex(nodes), total)
            made = [_write_steps(_steps(levels, slot)) + path for slot in range(len(levels[0]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp] * len(made), pa.string()),
                 pa.array(chunk * SLOTS + np.arange(len(made)), pa.int64()), pa.array(made, pa.binary())],
                names=_PATHS.fieldNames(),
            )


def _down(rounds: list[DataFrame], paths: DataFrame | None) -> DataFrame:
    """Paths of the nodes of the first round's arrays; none given: the last round has the root."""
    for arrays in reversed(rounds):
        known = arrays.withColumn("path", F.lit(b"")) if paths is None else arrays.join(paths, ["grp", "chunk"])
        paths = known.select("grp", "chunk", "total", "nodes", "path").mapInArrow(_descend, _PATHS)
    return paths


def _prove(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Proof and folded root of every leaf of an array."""
    arrow = to_arrow_schema(_PROOFS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, total, nodes, changed, path, subroot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels, above = reduced(_hex(nodes), total), _read_steps(path)
                shared = b"".join(b"".join(r[:own] + r[own + 1 :]) for r, own in above)
                frames = [(b"".join(r[:own]), b"".join(r[own + 1 :])) for r, own in above]
                proofs, folded = [], []
                for slot, node in enumerate(_hex(changed)):
                    proof = sha256()
                    for r, own in _steps(levels, slot):
                        left, right = b"".join(r[:own]), b"".join(r[own + 1 :])
                        proof.update(left + right)
                        node = sha256(left + node + right).hexdigest().encode()
                    proof.update(shared)
                    for left, right in frames:
                        node = sha256(left + node + right).hexdigest().encode()
                    proofs.append(proof.hexdigest())
                    folded.append(node.decode())
                n = len(folded)
                columns = (
                    ids, [x.decode() for x in levels[0]], [subroot] * n, [root] * n, proofs, folded,
                    [x == root for x in folded],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return run


def proofs(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang",
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf hashes ``fields``.  ``changed`` gives other values of some fields: the tampered
    row, whose leaf is folded with the original siblings.  ``key`` is an integer.  Groups stand in bytewise order, null first.  Null ids come first in
    their group, rows of one id in the order of their leaves; equal rows are leaves of
    their own, one after the other.  The rows of one id that differ are ranked in one
    task, which spills.  Null and empty texts are hashed as they are, other columns are
    left out, and an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    new = changed or {}
    column = {f: F.col(f"`{f}`") for f in fields}
    rows = docs.select(
        # bytewise order of this text is the order of groups, null first
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-")).alias("grp"),
        F.col(f"`{key}`").cast("long").alias("id"),
        F.unhex(leaf_hash(list(column.values()))).alias("leaf"),
        F.unhex(leaf_hash([new.get(f, c) for f, c in column.items()])).alias("changed"),
    ).withColumn("changed", F.expr("nullif(changed, leaf)"))
    rows = stored(rows, "leaves")
    words = stored(bitmap_words(rows), "bitmap-words")
    sizes = words.groupBy("grp").agg(F.sum("n").alias("total"))
    groups = stored(with_surrogate_key(sizes, ["grp"], "place").withColumn("place", F.col("place") - 1), "groups")
    n_groups, most = groups.agg(F.count(F.lit(1)), F.max("total")).first()
    if not n_groups:
        return spark.createDataFrame([], _PROOFS).withColumnRenamed("id", key)
    rounds = _rounds(places(rows, words).join(groups.select("grp", "total"), "grp"), most, "slots")
    subroots = rounds[-1].select("grp", F.col("digest").alias("leaf")).join(groups.select("grp", "place"), "grp")
    top = subroots.select(
        F.lit("").alias("grp"), F.lit(n_groups).cast("long").alias("total"), "place",
        F.lit(None).cast("long").alias("id"), "leaf", F.lit(None).cast("binary").alias("changed"),
    )
    top_rounds = _rounds(top, n_groups, "top-slots")
    root = bytes(top_rounds[-1].select("digest").first()[0]).hex()
    # down from the root: every subroot's path, then every array's
    of_groups = _down(top_rounds, None).select(F.col("chunk").alias("place"), "path")
    paths = groups.join(of_groups, "place").select("grp", F.lit(0).cast("long").alias("chunk"), "path")
    paths = _down(rounds[1:], paths)
    named = subroots.select("grp", F.lower(F.hex("leaf")).alias("subroot"))
    found = (
        rounds[0].join(paths, ["grp", "chunk"]).join(named, "grp")
        .select("ids", "total", "nodes", "changed", "path", "subroot")
        .mapInArrow(_prove(root), _PROOFS)
    )
    return found.withColumnRenamed("id", key)
