"""Corpus lifecycle and revision queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import corpus, linking, search
from dossier.operators import revisions as tree
from dossier.operators.gate import recall
from dossier.scratch import shared_folder
from dossier.registry import query
from dossier.views import Tables

REVISIONS_SQL = """
  old AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 10 != 9),
  new AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN sha256(text || '!') ELSE sha256(text) END AS digest FROM documents WHERE doc_id % 10 != 3)"""


def revisions(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs = t.raw("documents")
    old = docs.where("doc_id % 10 != 9").select("doc_id", F.sha2("text", 256).alias("digest"))
    changed = F.when(F.col("doc_id") % 10 == 4, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    return old, docs.where("doc_id % 10 != 3").select("doc_id", changed.alias("digest"))


@query("so_revision_diff", f"WITH {REVISIONS_SQL} SELECT doc_id, CASE WHEN o.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'removed' WHEN o.digest = n.digest THEN 'same' ELSE 'changed' END AS change FROM old o FULL JOIN new n USING (doc_id)")
def so_revision_diff(t: Tables) -> DataFrame:
    return corpus.revision_diff(*revisions(t), "doc_id", "digest")


@query("so_scope_prune", f"WITH {REVISIONS_SQL} SELECT doc_id FROM old WHERE NOT (doc_id % 2 = 1 AND doc_id NOT IN (SELECT doc_id FROM new))")
def so_scope_prune(t: Tables) -> DataFrame:
    """Documents of scopes listed anew that are no longer listed leave; other scopes stay."""
    old, new = revisions(t)
    listed = old.where("doc_id % 2 = 1").join(new, "doc_id", "left_semi").select("doc_id")
    return old.where("not doc_id % 2 = 1").select("doc_id").unionByName(listed)


def tree_sql(table: str) -> str:
    """The top of the hash tree over ``table(doc_id, digest)``, with leaves of 64 keys."""
    return f"""(SELECT sha256(string_agg(node || ':' || h, ',' ORDER BY node)) FROM (SELECT leaf // 256 AS node, sha256(string_agg(leaf || ':' || h, ',' ORDER BY leaf)) AS h FROM
    (SELECT doc_id // 64 AS leaf, sha256(string_agg(doc_id || chr(31) || digest, chr(30) ORDER BY doc_id || chr(31) || digest)) AS h FROM {table} GROUP BY 1) GROUP BY 1))"""


REVISION_SQL = f"""{REVISIONS_SQL}, r AS (SELECT doc_id, coalesce(n.digest, o.digest) AS digest, n.digest IS NOT NULL AND o.digest IS DISTINCT FROM n.digest AS rewritten FROM (SELECT * FROM old WHERE doc_id % 10 != 3) o FULL JOIN new n USING (doc_id)),
  ids AS (SELECT sha256('|' || {tree_sql("old")})[1:16] AS parent), named AS (SELECT parent, sha256(parent || '|' || {tree_sql("r")})[1:16] AS revision FROM ids)"""


def two_revisions(t: Tables) -> tuple[str, str, str]:
    """A folder with two revisions, the second from the first without removals and with what came in, and their names."""
    old, new = revisions(t)
    root = shared_folder(t.spark, "revisions")
    whole = t.spark.range(1).select(F.lit(True).alias("complete"))
    first = tree.publish(root, old, "doc_id", "digest", whole, per_leaf=64)
    return root, first, tree.publish(root, new, "doc_id", "digest", whole, first, old.join(new, "doc_id", "left_anti").where("doc_id % 10 = 3"))


@query("co_revision", f"WITH {REVISION_SQL} SELECT doc_id, digest, rewritten, revision, parent FROM r, named")
def co_revision(t: Tables) -> DataFrame:
    """Two revisions are published and the second is read back by its name."""
    root, first, second = two_revisions(t)
    return tree.read(t.spark, root, second).withColumns({"revision": F.lit(second), "parent": F.lit(first)})


@query("co_revision_changes", f"WITH {REVISION_SQL} SELECT doc_id, CASE WHEN o.digest IS NULL THEN 'added' WHEN r.digest IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old o FULL JOIN r USING (doc_id) WHERE o.digest IS DISTINCT FROM r.digest")
def co_revision_changes(t: Tables) -> DataFrame:
    """What differs between two published revisions, found by going down their trees where hashes differ."""
    return tree.changes(t.spark, *two_revisions(t))


@query("co_verify_revision", "SELECT 'document' AS level, CAST(doc_id AS VARCHAR) AS at, 'tampered' AS fault FROM documents WHERE doc_id % 10 = 4")
def co_verify_revision(t: Tables) -> DataFrame:
    """A published revision whose texts do not all have the digest that was stated for them, verified from documents to top."""
    root = shared_folder(t.spark, "revisions")
    text = F.when(F.col("doc_id") % 10 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    docs = t.raw("documents").select("doc_id", F.sha2("text", 256).alias("digest"), text.alias("text"))
    return tree.verify(t.spark, root, tree.publish(root, docs, "doc_id", "digest", t.spark.range(1).select(F.lit(True).alias("complete"))), "text")


@query("co_verify", f"WITH {REVISIONS_SQL} SELECT doc_id, CASE WHEN n.digest IS NULL THEN 'missing' WHEN n.digest != o.digest THEN 'tampered' END AS fault FROM old o LEFT JOIN new n USING (doc_id) WHERE n.digest IS NULL OR n.digest != o.digest")
def co_verify(t: Tables) -> DataFrame:
    """Stored rows hashed again and held against the manifest."""
    manifest, _ = revisions(t)
    stored = t.raw("documents").where("doc_id % 10 != 3").select("doc_id", F.when(F.col("doc_id") % 10 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return corpus.verify(stored, manifest, "doc_id", "text", "digest")


INVENTORY_SQL = """
  per AS (SELECT number, count(*) AS n FROM (SELECT number FROM entities UNION ALL SELECT number FROM entities WHERE CAST(number AS BIGINT) % 40 = 5) WHERE CAST(number AS BIGINT) % 25 != 2 GROUP BY 1),
  reviews AS (SELECT DISTINCT number, CASE WHEN page_id % 20 = 7 THEN 'https://shared.example.org/review' ELSE url END AS url FROM review_reports),
  dated AS (SELECT url, term, CASE WHEN group_id % 12 != 5 THEN held_on END AS held_on FROM meetings),
  work AS (SELECT term, 'original' AS kind, number AS item, CASE WHEN n IS NULL THEN 'missing_original' WHEN n > 1 THEN 'several_originals' END AS gap FROM entities LEFT JOIN per USING (number)
    UNION ALL SELECT term, 'review', url, CASE WHEN term IS NULL THEN 'unknown_bill' WHEN count(*) OVER (PARTITION BY url) > 1 THEN 'shared_url' END FROM reviews LEFT JOIN (SELECT number, term FROM entities) USING (number)
    UNION ALL SELECT term, 'minutes', url, CASE WHEN held_on IS NULL THEN 'missing_date' END FROM dated WHERE held_on IS NULL OR held_on BETWEEN DATE '2020-01-10' AND DATE '2023-06-30')"""


def inventories(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Bills, some without an original or with two; reviews, some at one address; meetings, some without a date."""
    k = F.col("number").cast("long")
    originals = t.entities.select("number").unionByName(t.entities.where(k % 40 == 5).select("number")).where(k % 25 != 2)
    reviews = t.review_reports.select("number", F.when(F.col("page_id") % 20 == 7, "https://shared.example.org/review").otherwise(F.col("url")).alias("url"))
    meetings = t.meetings.select("url", "term", F.when(F.col("group_id") % 12 != 5, F.col("held_on")).alias("held_on"))
    return corpus.work_inventory(t.entities.select("number", "term"), originals, reviews, meetings, "2020-01-10", "2023-06-30")


@query("co_inventory", f"WITH {INVENTORY_SQL} SELECT term, kind, count(*) FILTER (WHERE gap IS NULL) AS items, count(gap) AS gaps, CASE WHEN term IS NOT NULL AND term != 16 THEN count(*) FILTER (WHERE gap IS NULL) END AS expected FROM work GROUP BY 1, 2")
def co_inventory(t: Tables) -> DataFrame:
    """Work of each term and kind; where the term's metadata is incomplete (16) the expectation is unknown."""
    items, gaps = inventories(t)
    whole = t.entities.select("term").unionByName(t.meetings.select("term")).distinct().withColumn("complete", F.col("term") != 16)
    return corpus.expected_work(items, gaps, whole)


@query("co_inventory_gaps", f"WITH {INVENTORY_SQL} SELECT term, kind, item, gap FROM work WHERE gap IS NOT NULL")
def co_inventory_gaps(t: Tables) -> DataFrame:
    return inventories(t)[1].select("term", "kind", "item", "gap")


ATTEMPTS_SQL = """
  attempts AS (SELECT event_id, user_id AS work_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'permanent' ELSE 'retryable' END AS outcome FROM events),
  ledger AS (SELECT work_id, count(*) AS attempts, max_by(outcome, (CASE outcome WHEN 'success' THEN 1 ELSE 0 END, event_id)) AS outcome FROM attempts GROUP BY 1)"""


def ledger(t: Tables) -> DataFrame:
    """Latest outcome and attempts of every work item; a success is final."""
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "permanent").otherwise("retryable")
    attempts = t.raw("events").select("event_id", F.col("user_id").alias("work_id"), outcome.alias("outcome"))
    return attempts.groupBy("work_id").agg(F.count("*").alias("attempts"), F.max_by("outcome", F.struct(F.col("outcome") == "success", "event_id")).alias("outcome"))


@query("co_outcome_ledger", f"WITH {ATTEMPTS_SQL} SELECT *, outcome = 'retryable' AND attempts < 80 AS next_batch FROM ledger")
def co_outcome_ledger(t: Tables) -> DataFrame:
    return ledger(t).withColumn("next_batch", (F.col("outcome") == "retryable") & (F.col("attempts") < 80))


@query("co_merge_checkpoint", f"WITH {REVISIONS_SQL} SELECT o.doc_id, o.doc_id % 3 = 0 AS done FROM old o JOIN new n ON o.doc_id = n.doc_id AND o.digest IS NOT DISTINCT FROM n.digest WHERE o.doc_id % 7 != 2 AND o.doc_id % 8 != 1")
def co_merge_checkpoint(t: Tables) -> DataFrame:
    """Prior outcomes are kept for work that is byte-identical, of one inventory, parser and parent (null for none)."""
    old, new = revisions(t)
    k = F.col("doc_id")
    at = lambda df, parser, parent: df.select("doc_id", F.col("digest").alias("item_hash"), F.lit("inventory-1").alias("inventory"), parser.alias("parser"), parent.alias("parent"))
    prior = at(old, F.when(k % 7 == 2, "parser-1").otherwise("parser-2"), F.when(k % 2 == 0, "r0")).withColumn("done", k % 3 == 0)
    current = at(new, F.lit("parser-2"), F.when((k % 2 == 0) | (k % 8 == 1), "r0"))
    return corpus.merge_checkpoint(prior, current, "doc_id", ["item_hash", "inventory", "parser", "parent"]).select("doc_id", "done")


RECALL_SQL = """
  hits AS (SELECT query_id, doc_id, count(*) AS matched FROM query_terms JOIN doc_terms USING (term) GROUP BY 1, 2), sized AS (SELECT query_id, count(*) AS wanted FROM query_terms GROUP BY 1),
  gated AS (SELECT h.*, matched * 2 >= wanted AS relevant FROM hits h JOIN sized USING (query_id)), d AS (SELECT doc_id, doc_id % 400 AS identity, source AS url, CASE WHEN doc_id % 10 != 3 THEN DATE '2020-01-01' + CAST(doc_id % 2000 AS INTEGER) END AS day, CASE WHEN doc_id % 13 != 6 THEN lang END AS committee, doc_id % 2 = 0 AS minutes FROM documents),
  work AS (SELECT doc_id % 450 AS identity, count(*) AS targets, min(source) AS url FROM documents WHERE doc_id % 3 != 0 GROUP BY 1), copies AS (SELECT doc_id, row_number() OVER (PARTITION BY identity ORDER BY doc_id) AS copy FROM d),
  scoped AS (SELECT query_id, doc_id, CASE WHEN NOT relevant THEN 'irrelevant' WHEN minutes AND day IS NULL THEN 'missing_date' WHEN committee IS NULL THEN 'missing_committee' WHEN minutes AND day > DATE '2023-12-31' THEN 'after_as_of' WHEN committee NOT IN ('en', 'fr') THEN 'outside_committee' WHEN minutes AND day < DATE '2020-02-01' THEN 'outside_date'
      WHEN copy > 1 THEN 'duplicate' WHEN targets IS NULL THEN 'unmapped' WHEN targets > 1 THEN 'ambiguous' WHEN d.url != w.url THEN 'url_mismatch' ELSE 'promoted' END AS outcome FROM gated JOIN d USING (doc_id) JOIN copies USING (doc_id) LEFT JOIN work w USING (identity))"""


@query("rk_corpus_recall", f"WITH {RECALL_SQL}, n AS (SELECT query_id, outcome, count(*) AS n FROM scoped WHERE outcome != 'irrelevant' GROUP BY 1, 2) SELECT query_id, coalesce(CAST(sum(n) FILTER (WHERE outcome = 'promoted') AS BIGINT), 0) AS promoted, coalesce(string_agg(outcome || ':' || CAST(n AS VARCHAR), ',' ORDER BY outcome) FILTER (WHERE outcome != 'promoted'), '') AS reasons, CASE WHEN bool_or(outcome IN ('missing_date', 'missing_committee', 'duplicate', 'unmapped', 'ambiguous', 'url_mismatch')) THEN 'incomplete' ELSE 'verified' END AS status FROM n GROUP BY 1")
def rk_corpus_recall(t: Tables) -> DataFrame:
    """Any-term recall, the gate on the whole text (half of the query's words), scope, exact mapping; dates bind minutes alone."""
    k = F.col("doc_id")
    relevant = search.match_hits(t.indexed("documents"), t.query_terms, 0.5)
    facts = t.raw("documents").select(
        "doc_id", (k % 400).alias("identity"), F.col("source").alias("url"), F.when(k % 10 != 3, F.date_add(F.lit("2020-01-01").cast("date"), (k % 2000).cast("int"))).alias("day"), F.when(k % 13 != 6, F.col("lang")).alias("committee"), (k % 2 == 0).alias("minutes")
    )
    work = t.raw("documents").where("doc_id % 3 != 0").select((k % 450).alias("identity"), F.col("source").alias("url"))
    mapped = linking.exact_mapping(facts, work, [F.asc("doc_id")])
    return recall(relevant.select("query_id", "doc_id"), mapped, "doc_id", ["en", "fr"], "2020-02-01", "2023-12-31")
