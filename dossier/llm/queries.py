"""Registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import decontamination, embedding_dedup, fingerprints, licenses, near_dedup, oracles, packing, pii, prefix_trie, quality, repair, secrets, token_files, tokens, toxicity
from dossier.llm.shared import written

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licences(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences")
    )


def op2_order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts move once, to the buckets in which each lies before the next; all else happens there."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edited = fingerprints.following(fingerprints.deal(docs), ["text"]).withColumn("next_text", F.coalesce("next_text", F.lit("")))
    edited = edited.select("doc_id", "bucket", "guard", "place", "text", fingerprints.edited_text().alias("edited"))
    version = F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("text")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")))
    facts = ["doc_id", "bucket", "guard", "place", "n_chars", "edited_sha256"]
    versions = edited.select("doc_id", "bucket", "guard", "place", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(version).alias("version")).select(*facts, "version.*")
    printed = fingerprints.order_min_hash(versions, "text", "fingerprint", known_by=["bucket", "place", "is_edited"])
    of = lambda flag: F.max(F.when(F.col("is_edited") == flag, F.col("fingerprint")))
    both = printed.groupBy(*facts).agg(of(False).alias("fingerprint"), of(True).alias("edited_fingerprint"))
    return fingerprints.following(both, ["fingerprint"]).where(~F.col("guard")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "entropy")]
    base = secrets.secret_digest(F.concat("assign", "access", "hex"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.secret_digest(secrets.all_spans()).alias("spans"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone", "added")]
    base = pii.pii_digest(F.concat("email", "ip", "card", "phone"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.pii_digest(pii.all_spans()).alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokens.default_tokenizer(), with_ids=False)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), tokens.default_tokenizer(), folder)
    return token_files.read_token_files(spark, folder, manifest, with_ids=False)


def is_held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~is_held_out()))
    scored = docs.select("doc_id", is_held_out().alias("held_out"), toxicity.score(docs, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.benchmark_matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    m = F.col("matches")
    return found.select(
        "doc_id", m["n_words"].alias("n_words"), m["n_hit"].alias("n_hit"), F.size(m["items"]).cast("long").alias("n_items"),
        decontamination.items_digest(m["items"]).alias("items_sha256"), (m["n_hit"] > 0).alias("contaminated"), m["longest"].alias("longest"),
        m["longest_item"].alias("longest_item"), m["longest_item_start"].alias("longest_item_start"), m["longest_start"].alias("longest_start"),
    )


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which the damage leaves nothing come back with zeros."""
    conversations = _table(spark, sf_dir, "conversations")
    found = repair.audits(repair.damaged(conversations))
    none = conversations.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in repair.COUNTS], F.lit("").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256")).distinct()
    every = found.unionByName(none).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*repair.COUNTS, "audit", "repaired_sha256")])
    return every.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = written(prefix_trie.lay_out(_table(spark, sf_dir, "conversations")), "turns-in-place")
    conv = F.col("conv")
    rebuilt = prefix_trie.spliced(laid, conv - conv % 5, F.crc32(conv.cast("string")) % 9)
    return prefix_trie.trie(rebuilt, laid.select("conv"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_licence_scan, op2_order_min_hash, op3_secret_scan, op4_personal_data, op5_packing, op6_token_files, op7_toxicity, op8_importance_resampling, op9_simhash_dedup, op10_decontamination, op11_embedding_dedup, op12_conversation_repair, op13_prefix_trie]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_licence_scan": licenses.oracle(), "op11_embedding_dedup": oracles.NEAR_VECTORS, "op12_conversation_repair": oracles.repaired(), "op13_prefix_trie": oracles.PREFIX_TRIE}
