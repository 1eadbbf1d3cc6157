"""One entity over several systems: links, components and curated keys.

Accounts of all systems are vertices.  Links come from reviews, from shared business
ids and from names of one city; what they connect is one entity.  Every account has
exactly one place in the cross-reference, matched or not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normalised_name
from tidemark.operators.components import allocate_keys, connected_components
from tidemark.operators.matching import propose_matches
from tidemark.session import stored

#: How a mapping came about, strongest first.
METHODS = ("MANUAL", "ID_MATCH", "NAME_MATCH", "UNMATCHED")
SYSTEMS = ("portfolio", "ledger", "crm")


def vertex(system: Column | str, account: Column | str) -> Column:
    """A name for an account over all systems."""
    return F.concat_ws(":", system, account)


def _accounts(accounts: DataFrame) -> DataFrame:
    """One row for each account; of repeated rows the smallest."""
    named = accounts.select(
        "system", F.col("id").cast("string").alias("account"),
        F.col("business_id").cast("string").alias("business_id"),
        normalised_name(F.col("name")).alias("name"), normalised_name(F.col("city")).alias("city"),
    ).where("system is not null and account is not null")
    return (
        named.groupBy("system", "account").agg(F.min(F.struct("business_id", "name", "city")).alias("r"))
        .select(vertex("system", "account").alias("id"), "system", "account", "r.*")
    )


def business_links(accounts: DataFrame) -> DataFrame:
    """(src, dst): every account of a business id that several systems know, and the smallest of them.

    A star for each id: as many links as accounts, whatever one id owns.
    """
    hubs = (
        accounts.where("business_id is not null").groupBy("business_id")
        .agg(F.min("id").alias("dst"), F.min("system").alias("a"), F.max("system").alias("b"))
        .where("a <> b").select("business_id", "dst")
    )
    return accounts.join(hubs, "business_id").select(F.col("id").alias("src"), "dst")


def name_links(accounts: DataFrame, rest: DataFrame, systems: tuple[str, ...], edits: int) -> DataFrame:
    """(src, dst, similarity): the best account of another system for each of ``rest``.

    Accounts without a name or a city have no such match.
    """
    usable = F.expr("name <> '' and city <> ''")
    columns = ["id", "name", "city", "system"]
    left = rest.where(F.col("system").isin(list(systems)) & usable).select(*columns)
    found = propose_matches(left, accounts.where(usable).select(*columns), edits, apart="system")
    return found.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), "similarity")


def _component_keys(members: DataFrame, known: DataFrame | None) -> DataFrame:
    """(component, curated_key) that a new run gives again.

    A known key stays with the component of the smallest account that had it, and a
    component keeps the smallest key that stays with it; so joined entities go by the
    older key, and of a divided one the first part keeps it.
    """
    components = members.select(F.col("component").alias("id")).distinct()
    if known is None:
        return allocate_keys(components, key="curated_key").withColumnRenamed("id", "component")
    had = members.join(
        known.select(vertex("system", F.col("account").cast("string")).alias("id"), "curated_key"), "id"
    )
    held = (
        had.groupBy("curated_key").agg(F.min(F.struct("id", "component")).alias("first"))
        .groupBy(F.col("first.component").alias("id")).agg(F.min("curated_key").alias("curated_key"))
    )
    # keys are never given twice: new ones follow the largest that ever was
    last = known.agg(F.coalesce(F.max("curated_key"), F.lit(0))).first()[0]
    added = allocate_keys(components.join(held, "id", "left_anti"), key="curated_key")
    return held.unionByName(
        added.withColumn("curated_key", F.col("curated_key") + F.lit(last))
    ).withColumnRenamed("id", "component")


def entity_members(
    accounts: DataFrame, known: DataFrame | None = None, reviews: DataFrame | None = None,
    edits: int = 1, systems: tuple[str, ...] = SYSTEMS,
) -> DataFrame:
    """(system, account, curated_key, match_method, similarity, verified, conflict): a row for every account.

    ``accounts`` has ``system``, ``id``, ``business_id``, ``name``, ``city``.  Accounts that
    share a business id with another system are linked by it; the others by the nearest
    name in the same city.  ``reviews`` (``left_system``, ``left_id``, ``right_system``,
    ``right_id``, ``accepted``) adds links that people confirmed and withdraws proposed names
    that they refused.  ``known`` (``system``, ``account``, ``curated_key``) is the result of
    an earlier run, whose keys stay.

    ``match_method`` is the strongest link at the account, ``similarity`` that of the name it
    was proposed by; ``verified`` says that its entity was reviewed and rests on no name that
    nobody confirmed; ``conflict`` that a system has two accounts in it.  Rows without a system
    or an id are left out; repeated accounts count once.
    """
    vertices = stored(_accounts(accounts).where(F.col("system").isin(list(systems))), "accounts")
    by_id = stored(business_links(vertices), "links-by-id")
    rest = stored(vertices.join(by_id.select(F.col("src").alias("id")), "id", "left_anti"), "rest")
    by_name = name_links(vertices, rest, systems, edits)
    empty = by_id.where("false")
    accepted = empty
    if reviews is not None:
        judged = reviews.select(
            vertex("left_system", F.col("left_id").cast("string")).alias("src"),
            vertex("right_system", F.col("right_id").cast("string")).alias("dst"), "accepted",
        )
        judged = judged.unionByName(judged.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "accepted"))
        judged = judged.join(vertices.select(F.col("id").alias("src")), "src", "left_semi").join(
            vertices.select(F.col("id").alias("dst")), "dst", "left_semi"
        )
        accepted = judged.where("accepted").select("src", "dst")
        by_name = by_name.join(judged.select("src", "dst").distinct(), ["src", "dst"], "left_anti")

    none = F.lit(None).cast("double").alias("similarity")
    kinds = (accepted, "MANUAL"), (by_id, "ID_MATCH"), (by_name, "NAME_MATCH")
    links = stored(
        reduce(DataFrame.unionByName, [
            x.select("src", "dst", F.lit(METHODS.index(m)).alias("rank"), "similarity" if m == "NAME_MATCH" else none)
            for x, m in kinds
        ]), "links",
    )
    touched = links.select(F.col("src").alias("id"), "rank", "similarity").unionByName(
        links.select(F.col("dst").alias("id"), "rank", none)
    )
    strongest = touched.groupBy("id").agg(
        F.min("rank").alias("rank"), F.max("rank").alias("weakest"), F.max("similarity").alias("similarity")
    )
    members = stored(
        connected_components(vertices.select("id", "system", "account"), links).join(strongest, "id", "left"),
        "members",
    )
    manual, by_names = METHODS.index("MANUAL"), METHODS.index("NAME_MATCH")
    per_system = members.groupBy("component", "system").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"), F.max("weakest").alias("weakest")
    )
    entities = per_system.groupBy("component").agg(
        (F.max("n") > 1).alias("conflict"),
        F.coalesce((F.min("rank") == manual) & (F.max("weakest") < by_names), F.lit(False)).alias("verified"),
    )
    keys = _component_keys(members.select("id", "component"), known)
    method = F.element_at(F.array(*map(F.lit, METHODS)), F.coalesce(F.col("rank") + 1, F.lit(len(METHODS))))
    return members.join(entities, "component").join(keys, "component").select(
        "system", "account", "curated_key", method.alias("match_method"),
        F.round("similarity", 4).alias("similarity"), "verified", "conflict",
    )


def entity_crossref(
    members: DataFrame, entity_type: str = "CLIENT", systems: tuple[str, ...] = SYSTEMS
) -> DataFrame:
    """(entity_type, <system>_id ..., curated_key, match_method, verified, conflict).

    The *n*-th accounts of an entity in each system share a row, so an entity without a
    conflict has one row, and every account stands in exactly one.  The method of a row is
    the strongest of the accounts in it.
    """
    nth = Window.partitionBy("curated_key", "system").orderBy("account")
    strength = F.array_position(F.array(*map(F.lit, METHODS)), F.col("match_method"))
    per_row = members.withColumn("nth", F.row_number().over(nth)).groupBy("curated_key", "nth").agg(
        *(F.max(F.when(F.col("system") == s, F.col("account"))).alias(f"{s}_id") for s in systems),
        F.min(strength).cast("int").alias("strength"), F.first("verified").alias("verified"),
        F.first("conflict").alias("conflict"),
    )
    return per_row.select(
        F.lit(entity_type).alias("entity_type"), *(f"{s}_id" for s in systems), "curated_key",
        F.element_at(F.array(*map(F.lit, METHODS)), F.col("strength")).alias("match_method"),
        "verified", "conflict",
    )


def coverage(accounts: DataFrame, crossref: DataFrame, systems: tuple[str, ...] = SYSTEMS) -> DataFrame:
    """(system, n_accounts, n_mapped, n_shared): accounts, those in the cross-reference, those of shared entities."""
    counted = _accounts(accounts).groupBy("system").agg(F.count(F.lit(1)).alias("n_accounts"))
    sides = F.array(*(F.struct(F.lit(s).alias("system"), F.col(f"{s}_id").alias("account")) for s in systems))
    listed = (
        crossref.select("match_method", F.explode(sides).alias("side")).where("side.account is not null")
        .groupBy(F.col("side.system").alias("system"))
        .agg(F.count(F.lit(1)).alias("n_mapped"), F.count_if(F.col("match_method") != "UNMATCHED").alias("n_shared"))
    )
    zero = F.lit(0).cast("long")
    return counted.join(listed, "system", "left").select(
        "system", "n_accounts", F.coalesce("n_mapped", zero).alias("n_mapped"),
        F.coalesce("n_shared", zero).alias("n_shared"),
    )
