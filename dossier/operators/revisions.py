"""Revisions of a corpus under a hash tree: what two revisions have in common is stored once and never compared.

Documents fall in leaves by ranges of their integer key (of a hash of any other key).  A leaf lists its
documents' keys and digests, a node 256 leaves, the top all nodes; each carries a SHA-256 of what is below
it.  A revision is one folder with the documents it brought and the lists, leaves and nodes that differ
from its parent's, and a manifest that is published last: without one a revision does not exist.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from dossier.scratch import names, publish_text, read_text, written

FAN_OUT = 256
HASHES = 1 << 32
LEAVES = "node long, leaf long, hash string, n long, home string, held string"
NODES = "node long, hash string, n long, held string"


class IncompleteError(ValueError):
    """A revision of a scope that is not complete is not written."""


@dataclass(frozen=True)
class Revision:
    """A manifest.  ``folders`` are those of the revision and of all before it, by name; ``width`` is a leaf's range."""

    revision: str
    parent: str | None
    top: str
    documents: int
    key: str
    digest: str
    width: int
    schema: str
    folders: dict[str, str]

    def columns(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))

    def key_type(self) -> str:
        return self.columns()[self.key].dataType.simpleString()


def opened(spark: SparkSession, root: str, revision: str) -> Revision:
    """The manifest of a published revision; ``IncompleteError`` if there is none."""
    if f"{revision}.json" not in names(spark, f"{root}/manifests"):
        raise IncompleteError(f"there is no revision {revision}")
    return Revision(**json.loads(read_text(spark, f"{root}/manifests/{revision}.json")))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """``(revision, parent, documents)`` of all published revisions; a row each."""
    told = [json.loads(read_text(spark, f"{root}/manifests/{name}")) for name in names(spark, f"{root}/manifests") if name.endswith(".json")]
    return spark.createDataFrame([(m["revision"], m["parent"], m["documents"]) for m in told], "revision string, parent string, documents long")


def _leaf(key: Column, integral: bool, width: int) -> Column:
    place = key.cast("long") if integral else F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long")
    return F.shiftright(place, width.bit_length() - 1)  # widths are powers of two


def _part(spark: SparkSession, root: str, held: Revision, part: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{root}/{folder}/{part}" for folder in held.folders.values()))


def _nodes(spark: SparkSession, root: str, held: Revision) -> DataFrame:
    return spark.read.schema(NODES).parquet(f"{root}/{held.folders[held.revision]}/nodes")


def _leaves(spark: SparkSession, root: str, held: Revision, nodes: DataFrame) -> DataFrame:
    """The leaves below the ``nodes(node, held)`` of a revision."""
    return _part(spark, root, held, "leaves", LEAVES).join(nodes.select("node", "held"), ["node", "held"]).select("node", "leaf", "hash", "n", "home")


def _entries(spark: SparkSession, root: str, held: Revision, leaves: DataFrame) -> DataFrame:
    """``(leaf, key, digest, home)``: the documents that the ``leaves(leaf, home)`` of a revision list, and the revision that brought each."""
    schema = f"leaf long, key {held.key_type()}, digest string, home string, held string"
    return _part(spark, root, held, "entries", schema).join(leaves.select("leaf", F.col("home").alias("held")), ["leaf", "held"]).select("leaf", "key", "digest", "home")


def _leaf_hashes(entries: DataFrame) -> DataFrame:
    """``(leaf, hash, n, keys)``; ``keys`` counts distinct keys that are not null.  A leaf is bounded by its range."""
    key = F.col("key").cast("string")
    lines = F.collect_list(F.concat(F.coalesce(key, F.lit("")), F.lit("\u001f"), F.coalesce("digest", F.lit("\u0000"))))
    return entries.groupBy("leaf").agg(F.sha2(F.array_join(F.array_sort(lines), "\u001e"), 256).alias("hash"), F.count("*").alias("n"), F.size(F.collect_set(key)).cast("long").alias("keys"))


def _above(below: DataFrame, at: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "hash"))), lambda x: F.concat(x[at].cast("string"), F.lit(":"), x["hash"])), ","), 256)


def _node_hashes(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("node").agg(_above(leaves, "leaf").alias("hash"), F.sum("n").alias("n"))


def publish(root: str, docs: DataFrame, key: str, digest: str, cells: DataFrame, parent: str | None = None, removed: DataFrame | None = None, per_leaf: int = 4096) -> str:
    """Write the revision that ``docs(key, digest, ...)`` make of the ``parent`` under ``root``, and return its name.

    ``docs`` are upserts: documents of the parent with their keys are replaced where the digest differs,
    those of ``removed(key)`` leave.  The name is a hash of the parent's name and the top of the tree, so
    equal content of equal parents is one revision and is not written again.  ``cells(complete)`` is the
    coverage; unless all of it is complete, and the parent is there, nothing is written and
    ``IncompleteError`` is raised.  Null and repeated keys and other columns than the parent's are a
    ``ValueError``.  Only documents that changed are written, and the lists of their leaves; other leaves
    are not read.  Leaves have at most ``per_leaf`` integer keys, or about as many of another type.
    """
    spark = docs.sparkSession
    short = cells.where("not complete").count()
    if short or not cells.take(1):
        raise IncompleteError(f"{short} scopes are not complete" if short else "no scope is covered")
    before = opened(spark, root, parent) if parent is not None else None
    integral = isinstance(docs.schema[key].dataType, IntegralType)
    if before is None:
        width = 1 << (per_leaf.bit_length() - 1) if integral else HASHES >> max(0, -(-docs.count() // per_leaf) - 1).bit_length()
    elif before.columns().simpleString() != docs.schema.simpleString():
        raise ValueError("a revision has the columns of its parent")
    else:
        width = before.width
    named = docs.select(_leaf(F.col(key), integral, width).alias("leaf"), F.col(key).alias("key"), F.col(digest).alias("digest"))

    fresh = F.lit(None).cast("string")  # stands for the name of the new revision, which its content gives
    if before is None:
        listed = written(named.withColumn("home", fresh), "entries")
        hashes = written(_leaf_hashes(listed), "hashes")
        changed = hashes
    else:
        gone = docs.select(F.col(key).alias("key")).limit(0) if removed is None else removed.select(F.col(key).alias("key")).distinct()
        touched = named.select("leaf").unionByName(gone.select(_leaf(F.col("key"), integral, width).alias("leaf"))).distinct()
        nodes = _nodes(spark, root, before)
        near = nodes.join(touched.select(F.floor(F.col("leaf") / FAN_OUT).alias("node")).distinct(), "node", "left_semi")
        old_leaves = written(_leaves(spark, root, before, near), "leaves")
        old = _entries(spark, root, before, old_leaves.join(touched, "leaf", "left_semi"))
        new = named.select(F.col("leaf").alias("_leaf"), "key", F.col("digest").alias("_digest"), F.lit(True).alias("_new"))
        differs = F.col("_new").isNotNull() & (F.col("home").isNull() | ~F.col("digest").eqNullSafe(F.col("_digest")))
        both = old.join(new, "key", "full_outer").join(gone, "key", "left_anti")
        listed = written(both.select(F.coalesce("leaf", "_leaf").alias("leaf"), "key", F.when(differs, F.col("_digest")).otherwise(F.col("digest")).alias("digest"), F.when(differs, fresh).otherwise(F.col("home")).alias("home")), "entries")
        hashes = written(_leaf_hashes(listed), "hashes")
        changed = hashes.join(old_leaves.select("leaf", "hash"), ["leaf", "hash"], "left_anti")
    if hashes.where("n != keys").take(1):
        raise ValueError("keys of a revision are distinct and not null")

    brought = changed.select(F.floor(F.col("leaf") / FAN_OUT).alias("node"), "leaf", "hash", "n", fresh.alias("home"))
    if before is None:
        leaves, kept = written(brought, "leaves"), None
    else:
        out = touched.join(hashes, "leaf", "left_anti").select("leaf").unionByName(changed.select("leaf"))
        stale = old_leaves.join(out, "leaf", "left_semi").select("node").unionByName(brought.select("node")).distinct()
        leaves = written(old_leaves.join(stale, "node", "left_semi").join(out, "leaf", "left_anti").unionByName(brought), "leaves")
        kept = nodes.join(stale, "node", "left_anti")
    tops = _node_hashes(leaves).withColumn("held", fresh)
    tops = written(tops if kept is None else tops.unionByName(kept), "nodes")
    whole = tops.agg(_above(tops, "node").alias("top"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()

    name = hashlib.sha256(f"{parent or ''}|{whole.top}".encode()).hexdigest()[:16]
    if f"{name}.json" in names(spark, f"{root}/manifests"):
        return name
    folder = f"parts/{name}-{uuid.uuid4().hex}"
    own = lambda df, column: df.withColumn(column, F.coalesce(column, F.lit(name)))
    told = lambda df: df.withColumn("held", F.lit(name))
    lists = told(own(listed.join(changed.select("leaf"), "leaf", "left_semi"), "home"))
    lists.repartitionByRange("leaf").sortWithinPartitions("leaf", "key").write.parquet(f"{root}/{folder}/entries")
    told(own(leaves, "home")).repartitionByRange("node").sortWithinPartitions("node", "leaf").write.parquet(f"{root}/{folder}/leaves")
    own(tops, "held").repartitionByRange("node").sortWithinPartitions("node").write.parquet(f"{root}/{folder}/nodes")
    bodies = docs if before is None else docs.join(listed.where("home is null").select(F.col("key").alias(key)), key, "left_semi").select(*docs.columns)
    bodies.withColumn("_home", F.lit(name)).write.parquet(f"{root}/{folder}/documents")
    folders = {**(before.folders if before else {}), name: folder}
    held = Revision(name, parent, whole.top, whole.n, key, digest, width, docs.schema.json(), folders)
    publish_text(spark, f"{root}/manifests/{name}.json", json.dumps(asdict(held)))
    return name


def _all_entries(spark: SparkSession, root: str, held: Revision) -> DataFrame:
    return _entries(spark, root, held, _leaves(spark, root, held, _nodes(spark, root, held)))


def _bodies(spark: SparkSession, root: str, held: Revision) -> DataFrame:
    return _part(spark, root, held, "documents", StructType([*held.columns().fields]).add("_home", "string"))


def read(spark: SparkSession, root: str, revision: str) -> DataFrame:
    """The documents of a revision with ``rewritten``: whether this revision brought them."""
    held = opened(spark, root, revision)
    bodies = _bodies(spark, root, held)
    if held.parent is not None:
        live = _all_entries(spark, root, held).select(F.col("key").alias(held.key), F.col("home").alias("_home"))
        bodies = bodies.join(live, [held.key, "_home"], "left_semi")
    return bodies.withColumn("rewritten", F.col("_home") == revision).select(*held.columns().names, "rewritten")


def changes(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """``(key, change)`` of documents added, changed or removed between two revisions.

    Goes down only where hashes differ: equal tops read the two manifests and nothing else, equal nodes
    none of their leaves, equal leaves none of their documents.
    """
    a, b = opened(spark, root, old), opened(spark, root, new)
    if (a.key, a.key_type()) != (b.key, b.key_type()):
        raise ValueError("the revisions have other keys")
    if a.top == b.top and a.width == b.width:
        return spark.createDataFrame([], f"`{a.key}` {a.key_type()}, change string")
    one, two = _nodes(spark, root, a), _nodes(spark, root, b)
    if a.width == b.width:
        one, two = one.join(two, ["node", "hash"], "left_anti"), two.join(one, ["node", "hash"], "left_anti")
    x, y = _leaves(spark, root, a, one), _leaves(spark, root, b, two)
    if a.width == b.width:
        x, y = x.join(y, ["leaf", "hash"], "left_anti"), y.join(x, ["leaf", "hash"], "left_anti")
    o = _entries(spark, root, a, x).select("key", F.col("digest").alias("o"), F.lit(True).alias("in_old"))
    n = _entries(spark, root, b, y).select("key", F.col("digest").alias("n"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return o.join(n, "key", "full_outer").select(F.col("key").alias(a.key), change.alias("change")).where("change is not null")


def verify(spark: SparkSession, root: str, revision: str, text: str) -> DataFrame:
    """``(level, at, fault)``: what of a revision is missing or is not what the hash above it says.

    Documents by the SHA-256 of their ``text``, leaves by their lists, nodes by their leaves, the top by the nodes.
    """
    held = opened(spark, root, revision)
    nodes = _nodes(spark, root, held)
    leaves = _leaves(spark, root, held, nodes)
    entries = _entries(spark, root, held, leaves)
    bodies = _bodies(spark, root, held).select(F.col(held.key).alias("key"), F.col("_home").alias("home"), F.sha2(text, 256).alias("found"), F.lit(True).alias("there"))
    fault = lambda there, fits: F.when(there.isNull(), "missing").when(~fits, "tampered").alias("fault")
    found = F.col("found")
    own = entries.join(bodies, ["key", "home"], "left").select(F.lit("document").alias("level"), F.col("key").cast("string").alias("at"), fault(F.col("there"), found.eqNullSafe(F.col("digest"))))
    parts = [own]
    for level, told, again in (("leaf", leaves, _leaf_hashes(entries)), ("node", nodes, _node_hashes(leaves))):
        joined = told.select(level, "hash").join(again.select(level, F.col("hash").alias("found")), level, "left")
        parts.append(joined.select(F.lit(level).alias("level"), F.col(level).cast("string").alias("at"), fault(found, found == F.col("hash"))))
    parts.append(nodes.agg(_above(nodes, "node").alias("found")).select(F.lit("top").alias("level"), F.lit(revision).alias("at"), fault(found, found == F.lit(held.top))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("fault is not null")
