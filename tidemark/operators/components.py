"""Connected components, and keys that stay with what they were given to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedupe import with_surrogate_key
from tidemark.session import stored


def _signature(edges: DataFrame) -> tuple:
    """Two sets of edges are taken for equal if these agree."""
    hashed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed.cast("decimal(38,0)")), F.bit_xor(hashed)).first())


def star_edges(edges: DataFrame) -> DataFrame:
    """(id, component) for every id with an edge to a smaller one of its component.

    Alternating stars: every vertex links its larger neighbours, then its smaller ones, to
    the smallest it knows.  The number of edges never grows, chains halve from round to
    round, and a hub is one minimum and a join with one row for it.  Each round is a table
    in the shared folder, so a lost executor costs one round.
    """
    found = stored(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(), "edges",
    )
    before = None
    while (now := _signature(found)) != before:
        before = now
        both = found.unionAll(found.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return found.select(F.col("u").alias("id"), F.col("v").alias("component"))


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices`` (``id`` and any other columns) with ``component``: the smallest id reachable.

    ``edges`` has ``src`` and ``dst`` of the type of ``id``; null ends, loops and repeated
    edges say nothing.  A vertex without an edge is its own component.
    """
    return vertices.join(star_edges(edges), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )


def allocate_keys(ids: DataFrame, known: DataFrame | None = None, key: str = "key") -> DataFrame:
    """(id, key) of every known and every new id.

    Known ids keep their key.  New ones get consecutive keys after the largest known, in
    id order, from a range partitioning: no task sorts them all.  Null ids get none.
    """
    fresh = ids.select("id").where("id is not null").distinct()
    if known is None:
        return with_surrogate_key(fresh, ["id"], key).select("id", key)
    kept = known.select("id", F.col(key).cast("long").alias(key))
    last = kept.agg(F.coalesce(F.max(key), F.lit(0).cast("long"))).first()[0]
    added = with_surrogate_key(fresh.join(kept, "id", "left_anti"), ["id"], key)
    return kept.unionByName(added.select("id", (F.col(key) + F.lit(last)).alias(key)))
