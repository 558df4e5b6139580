"""End-user compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.catalog.aggregation import BINDINGS_SQL, bindings
from dossier.catalog.evidence import EDGES_SQL, RECORDS_SQL, evidence_records, marked
from dossier.catalog.ingestion import COHERENCE_SQL
from dossier.catalog.lifecycle import INVENTORY_SQL, inventories
from dossier.catalog.searching import bm25_sql, entity_search_sql, fused_sql, speech_sql
from dossier.catalog.texts import QUALITY_SQL, ag_parse_quality
from dossier.operators import evidence, linking, paging, search
from dossier.scratch import shared_folder, written
from dossier.plans import research
from dossier.registry import query
from dossier.sources import pages
from dossier.views import PAGE_SIZE, Tables

CORE_ORDER = ["bills", "bill_status", "bill_text", "agendas", "speeches", "government_responses", "subcommittee_minutes", "review_reports", "speech_context"]


SHOWN_WHERE = "role = 'user' AND kind = 'committee' AND term BETWEEN 18 AND 99 AND held_on >= DATE '2020-01-05'"


@query("pl_search_speeches", f"WITH {speech_sql(SHOWN_WHERE)} SELECT f.query_id, f.item, f.rank, f.score, lexical_rank, semantic_rank, matched_terms, previous, next, url FROM final f LEFT JOIN m USING (query_id, item) JOIN a USING (item) JOIN meetings USING (group_id) WHERE f.rank <= 10")
def pl_search_speeches(t: Tables) -> DataFrame:
    """Hybrid search within filters that hold before either list is cut."""
    return research.search_speeches(t, 10, role="user", kind="committee", day_from="2020-01-05")


@query("pl_speech_context", f"WITH {bm25_sql()} SELECT h.turn_id AS hit, t.turn_id, t.role, m.url FROM turns h JOIN turns t ON t.group_id = h.group_id AND t.seq BETWEEN h.seq - 2 AND h.seq + 2 JOIN meetings m ON m.group_id = t.group_id WHERE h.turn_id IN (SELECT turn_id FROM ranked WHERE rank <= 3)")
def pl_speech_context(t: Tables) -> DataFrame:
    """What stands around the three best turns of each benchmark text."""
    hits = search.bm25(t.indexed("turns"), t.query_words, 3).select("turn_id").distinct()
    near = linking.context(t.turns, t.turns.join(hits, "turn_id", "left_semi"), 2, 2)
    return near.join(t.turns.select("turn_id", "group_id"), "turn_id").join(t.meetings.select("group_id", "url"), "group_id").select("hit", "turn_id", "role", "url")


@query("pl_bill_status", "WITH a AS (SELECT number, count(DISTINCT turn_id) AS turns, max(held_on) AS last_debate, max_by(turn_id, (confidence, held_on, turn_id)) AS best_turn FROM links GROUP BY 1) SELECT number, coalesce(result, 'pending') AS status, coalesce(turns, 0) AS turns, last_debate, best_turn FROM entities LEFT JOIN a USING (number)")
def pl_bill_status(t: Tables) -> DataFrame:
    return research.bill_status(t)


ISSUE_SQL = f"""{fused_sql(k=30)},
  hits0 AS (SELECT query_id, item AS turn_id FROM final WHERE rank <= 30), linked0 AS (SELECT query_id, turn_id, number, confidence FROM hits0 JOIN links USING (turn_id) JOIN (SELECT DISTINCT number FROM entities) USING (number)),
  wanted AS (SELECT query_id, min(number) AS number FROM linked0 WHERE query_id % 4 = 2 GROUP BY 1), asked AS (SELECT query_id FROM wanted),
  linked AS (SELECT * FROM linked0 WHERE query_id NOT IN (SELECT query_id FROM asked) OR (query_id, number) IN (SELECT (query_id, number) FROM wanted)), hits AS (SELECT * FROM hits0 WHERE query_id NOT IN (SELECT query_id FROM asked) OR (query_id, turn_id) IN (SELECT (query_id, turn_id) FROM linked)),
  per AS (SELECT query_id, number, max(confidence) AS confidence, count(DISTINCT turn_id) AS n FROM linked GROUP BY 1, 2), known AS (SELECT p.*, result, proposed_at, processed_at FROM per p JOIN entities USING (number)),
  core AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, proposed_at DESC, number) AS k FROM (SELECT *, max(confidence) OVER (PARTITION BY query_id) AS best FROM known) WHERE confidence = best),
  bills AS (SELECT query_id, count(*) AS bills, max(CASE WHEN k = 1 THEN number END) AS top_bill, count(result) AS processed FROM core GROUP BY 1),
  events0 AS (SELECT query_id, proposed_at AS day FROM core UNION ALL SELECT query_id, processed_at FROM core WHERE processed_at IS NOT NULL UNION ALL SELECT c.query_id, t.held_on FROM core c JOIN linked l ON l.query_id = c.query_id AND l.number = c.number JOIN turns t ON t.turn_id = l.turn_id),
  tl AS (SELECT query_id, count(*) AS events, min(day) AS first_event, max(day) AS last_event FROM events0 GROUP BY 1),
  placed AS (SELECT query_id, group_id, held_on, seq, coalesce(CAST(seq - lag(seq) OVER (PARTITION BY query_id, group_id ORDER BY seq) > 3 AS INT), 1) AS starts, url IS NOT NULL AS cited, speaker FROM hits JOIN turns USING (turn_id) LEFT JOIN (SELECT group_id, url FROM meetings WHERE group_id % 50 != 3) USING (group_id)),
  th AS (SELECT query_id, count(*) AS speeches, CAST(sum(starts) AS BIGINT) AS threads, count(DISTINCT group_id) AS meetings, min(held_on) AS first_day, max(held_on) AS last_day, avg(cited::INT) AS provenance, count(DISTINCT CASE WHEN contains(speaker, 'system') THEN speaker END) AS suspects FROM placed GROUP BY 1)"""


@query("pl_explore_issue", f"WITH {ISSUE_SQL} SELECT query_id, speeches, threads, meetings, first_day, last_day, coalesce(bills, 0) AS bills, coalesce(processed, 0) AS processed, top_bill, coalesce(events, 0) AS events, first_event, last_event, query_id IN (SELECT query_id FROM asked) AS exact, CAST(greatest(0, 100 - CASE WHEN coalesce(bills, 0) = 0 THEN 25 ELSE 0 END - CASE WHEN speeches < 3 THEN 20 ELSE 0 END - CASE WHEN threads = 0 THEN 25 ELSE 0 END - round_even((1 - provenance) * 30, 0) - least(15, suspects * 3)) AS BIGINT) AS quality FROM th LEFT JOIN bills USING (query_id) LEFT JOIN tl USING (query_id)")
def pl_explore_issue(t: Tables) -> DataFrame:
    """Every fourth query asks for one exact number, the least that its turns are linked to."""
    hits = written(research.issue_hits(t, 30), "issue-hits")
    linked = written(research.linked_entities(t, hits), "issue-links")
    wanted = linked.where("query_id % 4 = 2").groupBy("query_id").agg(F.min("number").alias("number"))
    return research.explore_issue(t, hits, linked, wanted, t.meetings.where("group_id % 50 != 3"))


OVERVIEW_SQL = f"""{RECORDS_SQL}, {BINDINGS_SQL},
  per AS (SELECT number, count(*) AS records, string_agg(evidence_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY evidence_type) AS types FROM (SELECT number, evidence_type, count(*) AS n FROM bindings WHERE number IN (SELECT number FROM entities) GROUP BY 1, 2) GROUP BY 1),
  sized AS (SELECT number, count(*) AS records FROM bindings GROUP BY 1),
  pick AS (SELECT number, evidence_type, id, sort_key, CASE evidence_type {" ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(CORE_ORDER))} END AS priority, CASE WHEN evidence_type = 'bill_status' THEN row_number() OVER (PARTITION BY number, evidence_type ORDER BY sort_key DESC, id) ELSE row_number() OVER (PARTITION BY number, evidence_type ORDER BY sort_key, id) END AS k FROM bindings),
  core AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, priority, sort_key, id) AS place FROM pick),
  chosen AS (SELECT number, string_agg(evidence_type || '/' || id, ' ' ORDER BY place) AS core, max(CASE WHEN place = 1 THEN evidence_type || '/' || id END) AS representative FROM core WHERE place <= 8 GROUP BY 1)"""


@query("pl_overview", f"WITH {OVERVIEW_SQL} SELECT p.number, s.records, types, core, representative FROM per p JOIN sized s USING (number) JOIN chosen USING (number)")
def pl_overview(t: Tables) -> DataFrame:
    """For each proven entity: its evidence by axis, the core of eight with a representative of every axis first, and who stands for it."""
    return research.overview(evidence_records(t), bindings(t), t.entities.select("number"), CORE_ORDER, 8)


@query("pl_research", f"""WITH {EDGES_SQL}, {RECORDS_SQL.strip()}, ledger AS (SELECT evidence_type AS axis, count(*) AS checked, count(number) + count(CASE WHEN number IS NULL THEN meeting END) AS bound FROM records GROUP BY 1),
  kept AS (SELECT evidence_type AS axis, count(*) AS matched FROM records WHERE (number IS NULL OR number IN (SELECT number FROM entities)) AND (meeting IS NULL OR meeting IN (SELECT group_id FROM meetings)) GROUP BY 1),
  sound AS (SELECT bool_and(reasons = '') AS complete FROM verdicts), nets AS (SELECT count(*) FILTER (WHERE gap IS NULL) AS edges, count(gap) AS unresolved, count(DISTINCT gap) AS kinds FROM marked), fp AS (SELECT bit_xor(CAST('0x' || sha256(evidence_type || chr(31) || id || chr(31) || sort_key)[1:15] AS BIGINT)) AS xored FROM records)
  SELECT axis, checked, coalesce(matched, 0) AS matched, checked - coalesce(matched, 0) AS rejected, checked = coalesce(matched, 0) AND complete AND unresolved = 0 AS complete, edges, unresolved, kinds AS gap_kinds, xored AS snapshot FROM ledger LEFT JOIN kept USING (axis), sound, nets, fp""".replace("WITH ", f"WITH {COHERENCE_SQL.strip()}, ", 1))
def pl_research(t: Tables) -> DataFrame:
    """Collection coverage, strict filter, graph, records and ledger of one run: a row an axis, bound to the snapshot's fingerprint."""
    verdicts = pages.page_coherence(t.source_pages, ["dataset", "year"], PAGE_SIZE)
    graph = evidence.split(written(marked(t)[1].select("gap"), "gaps"))
    return research.run(evidence_records(t), verdicts, graph, t.entities, t.meetings)


@query("pl_result_page", f"WITH {RECORDS_SQL}, r AS (SELECT evidence_type, id, sort_key, row_number() OVER (PARTITION BY evidence_type ORDER BY sort_key, id) AS place, count(*) OVER (PARTITION BY evidence_type) AS total FROM records), p AS (SELECT * FROM r WHERE place BETWEEN 21 AND 40) SELECT evidence_type, id, sort_key, place, total, count(*) OVER (PARTITION BY evidence_type) AS returned, greatest(total - 40, 0) AS remaining, CASE WHEN total > 40 THEN CAST(40 AS BIGINT) END AS next_offset FROM p")
def pl_result_page(t: Tables) -> DataFrame:
    """The second page of twenty of each type of evidence, from the files that hold it."""
    held = paging.store(evidence_records(t).select("evidence_type", "id", "sort_key"), "evidence_type", ["sort_key", "id"], shared_folder(t.spark, "pages"))
    page = held.read(dict.fromkeys(held.axes(), 20), 20)
    after = F.when(F.col("remaining") > 0, F.lit(40).cast("long"))
    return page.select("evidence_type", "id", "sort_key", "place", "total", F.count("*").over(Window.partitionBy("evidence_type")).alias("returned"), "remaining", after.alias("next_offset"))


@query("pl_evidence_text", "SELECT turn_id, text, sha256(text) AS digest FROM turns JOIN meetings m USING (group_id) WHERE m.kind = 'plenary'")
def pl_evidence_text(t: Tables) -> DataFrame:
    wanted = t.meetings.where("kind = 'plenary'").select("group_id")
    return t.turns.join(wanted, "group_id", "left_semi").select("turn_id", "text", F.sha2("text", 256).alias("digest"))


@query("pl_get_speech", "SELECT turn_id, role, text, committee, t.held_on, url || '#' || CAST(seq AS VARCHAR) AS citation FROM turns t JOIN meetings m USING (group_id, committee)")
def pl_get_speech(t: Tables) -> DataFrame:
    joined = t.turns.join(t.meetings.select("group_id", "url"), "group_id")
    return joined.select("turn_id", "role", "text", "committee", "held_on", F.concat("url", F.lit("#"), F.col("seq").cast("string")).alias("citation"))


@query("pl_list_committees", "SELECT committee, count(*) AS meetings, min(held_on) AS first_date, max(held_on) AS last_date FROM meetings GROUP BY 1")
def pl_list_committees(t: Tables) -> DataFrame:
    return t.meetings.groupBy("committee").agg(F.count("*").alias("meetings"), F.min("held_on").alias("first_date"), F.max("held_on").alias("last_date"))


@query("pl_list_meetings", "SELECT kind, group_id, held_on, place FROM (SELECT kind, group_id, held_on, row_number() OVER (PARTITION BY kind ORDER BY held_on DESC, group_id) AS place FROM meetings WHERE term = 19) WHERE place <= 20")
def pl_list_meetings(t: Tables) -> DataFrame:
    order = Window.partitionBy("kind").orderBy(F.desc("held_on"), "group_id")
    return t.meetings.where("term = 19").select("kind", "group_id", "held_on", F.row_number().over(order).cast("long").alias("place")).where("place <= 20")


BILL_QUERIES = ["urgent household", "low", "customer#00000001 the", "medium machinery", "furniture para der"]
_BILLS_SQL = f"SELECT CAST(n_nationkey AS BIGINT) AS query_id, {BILL_QUERIES}[n_nationkey % 5 + 1] AS q, CASE WHEN n_nationkey % 2 = 0 THEN 'pending' END AS w_status, NULL::BIGINT AS w_term, NULL::VARCHAR AS w_committee FROM nation"


@query("pl_search_bills", f"""WITH {entity_search_sql(_BILLS_SQL, "SELECT number, text FROM bill_texts JOIN documents USING (doc_id)", 25)},
  o AS (SELECT number, count(DISTINCT turn_id) AS turns FROM links GROUP BY 1) SELECT query_id, number, part, rank, coalesce(result, 'pending') AS status, coalesce(turns, 0) AS turns FROM ranked JOIN entities USING (number) LEFT JOIN o USING (number)""")
def pl_search_bills(t: Tables) -> DataFrame:
    """Entities by any of a query's words, then those whose documents hold one, with status and how many turns speak of them."""
    k = F.col("n_nationkey")
    none = F.lit(None)
    wanted = t.raw("nation").select(k.cast("long").alias("query_id"), F.get(F.lit(BILL_QUERIES), (k % 5).cast("int")).alias("q"), F.when(k % 2 == 0, "pending").alias("status"), none.cast("long").alias("term"), none.cast("string").alias("committee"))
    return research.search_bills(t, wanted, 25)


@query("pl_corpus_build", f"""WITH {INVENTORY_SQL}, items AS (SELECT term, kind, item FROM work WHERE gap IS NULL), o AS (SELECT *, CASE CAST('0x' || sha256(item)[1:8] AS BIGINT) % 20 WHEN 3 THEN CASE WHEN kind = 'review' THEN 'permanent' ELSE 'success' END WHEN 7 THEN CASE WHEN kind = 'minutes' AND term = 19 THEN 'retryable' ELSE 'success' END ELSE 'success' END AS outcome FROM items),
  c AS (SELECT term, kind, count(*) AS expected, count(*) FILTER (WHERE outcome = 'success') AS built, count(*) FILTER (WHERE outcome = 'permanent') AS failed, count(*) FILTER (WHERE outcome = 'retryable') AS pending FROM o GROUP BY 1, 2) SELECT *, failed = 0 AND pending = 0 AS complete, CASE WHEN failed = 0 AND pending = 0 THEN built ELSE 0 END AS published FROM c""")
def pl_corpus_build(t: Tables) -> DataFrame:
    """Inventory, outcomes, next batch, coverage and publication: a revision is written for each complete scope and refused for the others."""
    items, _ = inventories(t)
    draw = F.conv(F.substring(F.sha2("item", 256), 1, 8), 16, 10).cast("long") % 20
    outcome = F.when((draw == 3) & (F.col("kind") == "review"), "permanent").when((draw == 7) & (F.col("kind") == "minutes") & (F.col("term") == 19), "retryable").otherwise("success")
    return research.build_corpus(items, items.withColumn("outcome", outcome), shared_folder(t.spark, "corpus"))


@query("pl_parser_review", f"WITH {QUALITY_SQL} SELECT count(*) AS documents, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(parsed) AS BIGINT) AS parsed, CAST(sum(correct) AS BIGINT) AS correct, count(*) FILTER (WHERE correct < expected OR parsed > expected) AS faulty, round(2 * sum(correct) / (sum(expected) + sum(parsed)), 6) AS f1 FROM q")
def pl_parser_review(t: Tables) -> DataFrame:
    """The parser over all transcripts, damaged ones among them, in one row."""
    each = ag_parse_quality(t)
    total = lambda c: F.sum(c).alias(c)
    f1 = F.round(2 * F.sum("correct") / (F.sum("expected") + F.sum("parsed")), 6)
    return each.agg(F.count("*").alias("documents"), total("expected"), total("parsed"), total("correct"), F.count(F.when((F.col("correct") < F.col("expected")) | (F.col("parsed") > F.col("expected")), 1)).alias("faulty"), f1.alias("f1"))
