"""Revisions share what they have in common, and damage is found where it is."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from dossier.operators import revisions


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def complete(spark, yes=True):
    return spark.createDataFrame([(yes,)], "complete boolean")


def stored(root, revision, part):
    return sum(os.path.getsize(f) for f in glob.glob(f"{root}/parts/{revision}-*/{part}/*.parquet"))


def corpus(spark, n):
    text = F.concat_ws(" ", *(F.sha2(F.concat("id", F.lit(str(i))), 512) for i in range(8)))
    return spark.range(n).select("id", text.alias("text")).withColumn("digest", F.sha2("text", 256))


def test_revisions_are_written_once_and_refused_when_incomplete(spark, tmp_path):
    root = str(tmp_path)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, digest string")
    whole = complete(spark)
    with pytest.raises(revisions.IncompleteError):
        revisions.publish(root, docs, "k", "digest", complete(spark, False))
    assert revisions.manifests(spark, root).count() == 0
    first = revisions.publish(root, docs, "k", "digest", whole)
    assert revisions.publish(root, docs, "k", "digest", whole) == first
    new = spark.createDataFrame([(2, "B"), (3, "c"), (4, "d")], "k long, digest string")
    second = revisions.publish(root, new, "k", "digest", whole, first, docs.where("k = 1"))
    assert rows(revisions.read(spark, root, second), "k", "digest", "rewritten") == [(2, "B", True), (3, "c", False), (4, "d", True)]
    assert rows(revisions.read(spark, root, first), "k", "digest") == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(revisions.manifests(spark, root), "revision", "documents") == sorted([(first, 3), (second, 3)])
    with pytest.raises(revisions.IncompleteError):
        revisions.publish(root, new, "k", "digest", whole, "unknown")


def test_a_small_change_writes_little_and_is_found_without_reading_the_rest(spark, tmp_path):
    root, docs = str(tmp_path), corpus(spark, 20_000)
    first = revisions.publish(root, docs, "id", "digest", complete(spark), per_leaf=64)
    new = docs.where("id >= 10000 and id < 10200").withColumn("text", F.upper("text")).withColumn("digest", F.sha2("text", 256))
    second = revisions.publish(root, new, "id", "digest", complete(spark), first)
    assert stored(root, second, "documents") < 0.02 * stored(root, first, "documents")
    assert stored(root, second, "entries") < 0.05 * stored(root, first, "entries")
    found = revisions.changes(spark, root, first, second)
    assert rows(found, "id", "change") == sorted(((i, "changed") for i in range(10_000, 10_200)), key=str)
    assert revisions.read(spark, root, second).count() == 20_000 and revisions.read(spark, root, second).where("rewritten").count() == 200
    third = revisions.publish(root, new, "id", "digest", complete(spark), second)
    assert third != second and stored(root, third, "documents") < 0.001 * stored(root, first, "documents") and revisions.changes(spark, root, second, third).count() == 0
    assert revisions.changes(spark, root, second, third).inputFiles() == []  # equal tops: the manifests alone


def test_leaves_that_empty_leave_the_tree_and_later_revisions_fill_them_again(spark, tmp_path):
    root, docs = str(tmp_path), corpus(spark, 300)
    first = revisions.publish(root, docs, "id", "digest", complete(spark), per_leaf=64)
    none = docs.limit(0)
    second = revisions.publish(root, none, "id", "digest", complete(spark), first, docs.where("id < 64"))
    third = revisions.publish(root, docs, "id", "digest", complete(spark), second)
    assert revisions.read(spark, root, second).count() == 236 and rows(revisions.read(spark, root, third), "id", "text") == rows(docs, "id", "text")
    assert {r.change for r in revisions.changes(spark, root, second, third).collect()} == {"added"}
    assert revisions.changes(spark, root, first, third).count() == 0
    gone = revisions.publish(root, none, "id", "digest", complete(spark), first, docs)
    assert revisions.read(spark, root, gone).count() == 0 and revisions.changes(spark, root, first, gone).count() == 300
    assert revisions.verify(spark, root, third, "text").count() == revisions.verify(spark, root, gone, "text").count() == 0


def test_keys_of_any_type_null_digests_and_refused_keys(spark, tmp_path):
    root = str(tmp_path)
    docs = spark.range(500).select(F.concat(F.lit("k"), "id").alias("name"), F.when(F.col("id") != 7, F.col("id").cast("string")).alias("digest"))
    first = revisions.publish(root, docs, "name", "digest", complete(spark), per_leaf=32)
    second = revisions.publish(root, docs.where("name = 'k7'").withColumn("digest", F.lit("x")), "name", "digest", complete(spark), first)
    assert rows(revisions.changes(spark, root, first, second), "name", "change") == [("k7", "changed")]
    empty = revisions.publish(root, docs.limit(0), "name", "digest", complete(spark))
    assert revisions.read(spark, root, empty).count() == 0 and revisions.changes(spark, root, empty, second).count() == 500
    for wrong in (docs.unionAll(docs.limit(1)), docs.withColumn("name", F.nullif("name", F.lit("k3")))):
        with pytest.raises(ValueError):
            revisions.publish(root, wrong, "name", "digest", complete(spark))
    with pytest.raises(ValueError):
        revisions.publish(root, docs.withColumn("more", F.lit(1)), "name", "digest", complete(spark), first)


def test_damage_is_found_at_its_level(spark, tmp_path):
    root, docs = str(tmp_path), corpus(spark, 2_000)
    name = revisions.publish(root, docs.withColumn("text", F.when(F.col("id") == 5, "other").otherwise(F.col("text"))), "id", "digest", complete(spark), per_leaf=64)
    assert rows(revisions.verify(spark, root, name, "text"), "level", "at", "fault") == [("document", "5", "tampered")]
    held = revisions.opened(spark, root, name)
    path = f"{root}/{held.folders[name]}/entries"
    spark.read.parquet(path).where("key != 70").write.parquet(f"{root}/less")
    os.rename(path, path + "-old")
    os.rename(f"{root}/less", path)
    assert ("leaf", "1", "tampered") in rows(revisions.verify(spark, root, name, "text"), "level", "at", "fault")
