"""Evidence graph: typed nodes, resolved edges, unresolved claims with the reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.scratch import written

#: The types of nodes and edges.
NODE_TYPES = ["bill", "bill_status", "bill_text", "meeting", "agenda", "minutes_document", "review_report", "document_page", "person", "speech", "government_response", "issue"]
EDGE_TYPES = [
    "has_status", "has_bill_text", "has_agenda", "agenda_for_bill", "has_minutes", "evidenced_by_minutes", "has_review_report", "has_page", "contains_speech", "page_contains_speech",
    "addresses_agenda", "discusses_bill", "made_speech", "derived_from_speech", "question_to", "answer_to", "follow_up_to", "continues", "has_issue", "identifies_issue", "discusses_issue",
]


def merge_nodes(claimed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``claimed(id, node_type, label, locator)`` to nodes and conflicts.

    Identical claims merge; a person keeps the least locator; any other difference under one id is a
    conflict, and that id is no node.  A column ``claims`` tells how many a row stands for: repeats have then been merged where it pays,
    and rows are moved once, by their id.
    """
    if "claims" not in claimed.columns:
        claimed = claimed.groupBy("id", "node_type", "label", "locator").agg(F.count("*").alias("claims"))  # repeats go before rows are moved
    own = F.when(F.col("node_type") != "person", F.col("locator"))
    each = claimed.repartition("id").groupBy("id", "node_type", "label", own.alias("_own")).agg(F.min("locator").alias("locator"), F.sum("claims").alias("claims"))
    merged = each.groupBy("id").agg(F.count("*").alias("versions"), F.min(F.struct("node_type", "label", "locator")).alias("n"), F.sum("claims").alias("claims"))
    nodes = merged.where("versions = 1").select("id", "n.node_type", "n.label", "n.locator", "claims")
    return nodes, merged.where("versions > 1").select("id", "versions", "claims")


def by_title(claims: DataFrame, nodes: DataFrame, node_type: str) -> tuple[DataFrame, DataFrame]:
    """``claims(source, title, edge_type, reason)`` that name their target by its title alone.

    A title that one node of the type has gives a claim on that node, no node leaves the title as a
    target that does not exist, and several nodes an unresolved claim with the gap ``ambiguous_target``.
    """
    own = nodes.where(F.col("node_type") == node_type).groupBy(F.col("label").alias("title")).agg(F.count("*").alias("n"), F.min("id").alias("one"))
    joined = claims.distinct().join(own, "title", "left")
    target = F.when(F.col("n") == 1, F.col("one")).otherwise(F.concat(F.lit(f"{node_type}-title:"), "title"))
    found = joined.select("source", target.alias("target"), "edge_type", "reason", F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))
    return found.where("not ambiguous").drop("ambiguous"), found.where("ambiguous").drop("ambiguous").withColumn("gap", F.lit("ambiguous_target"))


#: An end that more than one in so many claims name is looked up by itself; there are fewer such ends than this.
HEAVY = 1000


def _known(claims: DataFrame, ids: DataFrame, end: str, n: int) -> DataFrame:
    """``claims`` with ``<end>_known``: whether that end is among ``ids(id)``.

    Ends that many claims name are found by a count that is combined before it is shuffled, looked up once
    each and broadcast (fewer than ``HEAVY`` rows, whatever the table), so their claims are not brought together.
    """
    heavy = claims.groupBy(end).count().where(F.col("count") * HEAVY > n).select(F.col(end).alias("_end"))
    flags = heavy.join(ids.select(F.col("id").alias("_end"), F.lit(True).alias("_there")), "_end", "left").withColumn("_heavy", F.lit(True))
    told = claims.join(F.broadcast(flags), F.col(end) == F.col("_end"), "left")
    nowhere = F.concat(F.lit("\u0000"), F.xxhash64("source", "target").cast("string"))  # spreads the claims that need no lookup
    told = told.withColumn("_key", F.when(F.col("_heavy") | F.col(end).isNull(), nowhere).otherwise(F.col(end)))
    found = told.join(ids.select(F.col("id").alias("_key"), F.lit(True).alias("_found")), "_key", "left")
    return found.select(*claims.columns, F.when(F.col("_heavy"), F.col("_there")).otherwise(F.col("_found")).alias(f"{end}_known"))


def mark_edges(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """``claims(source, target, edge_type, reason)``, each distinct one once, with ``gap``: which end is no node, null if both are.

    The distinct claims are written once.  A null end is missing.
    """
    claims, ids = written(claims.select("source", "target", "edge_type", "reason").distinct(), "claims"), nodes.select("id")
    n = claims.count()
    joined = _known(_known(claims, ids, "source", n), ids, "target", n)
    return joined.select("source", "target", "edge_type", "reason", _gap(F.col("source_known").isNotNull(), F.col("target_known").isNotNull()).alias("gap"))


def _gap(source: Column, target: Column) -> Column:
    return F.when(~source & ~target, "missing_both").when(~source, "missing_source").when(~target, "missing_target")


#: Keys up to which what is known of them is broadcast.
FEW_KEYS = 500_000


def _kinds(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """``(key, bits)`` of the nodes of ``kinds``: an id is its kind, a colon and its key, and the bit of ``kinds[i]`` is ``1 << i``."""
    bits = F.create_map(*(F.lit(x) for i, kind in enumerate(kinds) for x in (kind, 1 << i)))
    kind = F.substring_index("id", ":", 1)
    return nodes.where(kind.isin(kinds)).select(F.expr("substring(id, instr(id, ':') + 1)").alias("key"), F.element_at(bits, kind).alias("bits"))


def _has(bits: str, i: int) -> Column:
    return F.coalesce(F.col(bits).bitwiseAND(1 << i), F.lit(0)) != 0


def _told(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), key)


def mark_one_key(claims: list[tuple[DataFrame, tuple[str, str, str, str]]], nodes: DataFrame) -> DataFrame:
    """Claims whose ends have one key, marked as by ``mark_edges``: of each table of keys its kinds of source and target, type and reason.

    The nodes and the claims of a key meet once, as bits; no claim is written out before its ends are known.
    """
    kinds = sorted({kind for _, edge in claims for kind in edge[:2]})
    own = [keys.select(F.col(keys.columns[0]).cast("string").alias("key"), F.lit(1 << (len(kinds) + i)).alias("bits")) for i, (keys, _) in enumerate(claims)]
    met = reduce(DataFrame.unionByName, own, _kinds(nodes, kinds)).groupBy("key").agg(F.bit_or("bits").alias("bits"))
    told = []
    for i, (_, (source, target, edge_type, reason)) in enumerate(claims):
        gap = _gap(_has("bits", kinds.index(source)), _has("bits", kinds.index(target)))
        edge = F.struct(_told(source, "key").alias("source"), _told(target, "key").alias("target"), F.lit(edge_type).alias("edge_type"), F.lit(reason).alias("reason"), gap.alias("gap"))
        told.append(F.when(_has("bits", len(kinds) + i), edge))
    return met.where(F.col("bits") >= 1 << len(kinds)).select(F.explode(F.array(*told)).alias("e")).where("e is not null").select("e.*")


def mark_pairs(pairs: DataFrame, edges: list[tuple[str, str, str, str, bool]], nodes: DataFrame, distinct: bool = False) -> DataFrame:
    """The claims that each distinct pair of keys makes, marked as by ``mark_edges``.

    ``edges`` has kinds of source and target, type and reason, and whether the source is the pair's second key.
    Pairs are made distinct, unless they are told to be ``distinct``, and looked up as two keys, once for all their claims; what few keys have nodes is broadcast.
    """
    at = ["first", "second"]
    pairs = pairs.select(*(F.col(c).cast("string").alias(name) for c, name in zip(pairs.columns, at)))
    pairs = pairs if distinct else pairs.distinct()
    kinds = {name: sorted({edge[j] for edge in edges for j in (0, 1) if at[(j + edge[4]) % 2] == name}) for name in at}
    for name in at:
        known = written(_kinds(nodes, kinds[name]).groupBy(F.col("key").alias(name)).agg(F.bit_or("bits").alias(f"{name}_bits")), "known-keys")
        if known.count() <= FEW_KEYS:
            known = F.broadcast(known)
        pairs = pairs.join(known, name, "left")
    told = []
    for source, target, edge_type, reason, turned in edges:
        a, b = (at[1], at[0]) if turned else (at[0], at[1])
        gap = _gap(_has(f"{a}_bits", kinds[a].index(source)), _has(f"{b}_bits", kinds[b].index(target)))
        told.append(F.struct(_told(source, a).alias("source"), _told(target, b).alias("target"), F.lit(edge_type).alias("edge_type"), F.lit(reason).alias("reason"), gap.alias("gap")))
    return pairs.select(F.explode(F.array(*told)).alias("e")).select("e.*")


def split(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, and unresolved claims with their gap."""
    return marked.where("gap is null").drop("gap"), marked.where("gap is not null")


def resolve_edges(claims: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``claims(source, target, edge_type, reason)`` to edges and unresolved claims.

    An edge stands only if both ends are nodes; repeats are dropped.  An unresolved claim says which end
    is missing.  Together they are all distinct claims.  Who uses both takes ``mark_edges``, which gives them in one pass.
    """
    return split(mark_edges(claims, nodes))
