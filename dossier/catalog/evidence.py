"""Evidence graph queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.catalog.linking import QA_SQL, relations
from dossier.operators import corpus, evidence, search
from dossier.scratch import written
from dossier.registry import query
from dossier.views import Tables

NODES_SQL = """
  claimed AS (SELECT 'bill:' || number AS id, 'bill' AS node_type, name AS label, number AS locator FROM entities
    UNION ALL SELECT 'status:' || number, 'bill_status', result, number FROM entities WHERE result IS NOT NULL UNION ALL SELECT 'text:' || CAST(doc_id AS VARCHAR), 'bill_text', source, digest FROM bill_texts
    UNION ALL SELECT 'meeting:' || CAST(group_id AS VARCHAR), 'meeting', committee, url FROM meetings UNION ALL SELECT 'minutes:' || CAST(group_id AS VARCHAR), 'minutes_document', kind, url FROM meetings
    UNION ALL SELECT 'report:' || CAST(page_id AS VARCHAR), 'review_report', 'review', url FROM review_reports UNION ALL SELECT 'page:' || CAST(group_id AS VARCHAR) || '/' || CAST(seq // 3 AS VARCHAR), 'document_page', CAST(seq // 3 AS VARCHAR), CAST(group_id AS VARCHAR) FROM turns
    UNION ALL SELECT 'speech:' || turn_id, 'speech', role, CAST(seq AS VARCHAR) FROM turns UNION ALL SELECT 'person:' || speaker, 'person', speaker, turn_id FROM turns UNION ALL SELECT 'agenda:' || number, 'agenda', title, CAST(group_id % 2 AS VARCHAR) FROM agenda
    UNION ALL SELECT 'response:' || turn_id, 'government_response', CASE WHEN seq % 2 = 1 THEN 'qa_response' ELSE 'statement' END, CAST(seq AS VARCHAR) FROM turns WHERE role = 'assistant' UNION ALL SELECT 'issue:' || CAST(item_id AS VARCHAR), 'issue', left(text, 40), CAST(item_id AS VARCHAR) FROM benchmark),
  merged AS (SELECT id, count(DISTINCT node_type || chr(31) || label || CASE WHEN node_type = 'person' THEN '' ELSE chr(31) || locator END) AS versions, min((node_type, label, locator)) AS n, count(*) AS claims FROM claimed GROUP BY 1),
  nodes AS (SELECT id, n[1] AS node_type, n[2] AS label, n[3] AS locator, claims FROM merged WHERE versions = 1)"""


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ref(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), key.cast("string"))


def _page(seq: Column) -> Column:
    return F.floor(seq / 3).cast("string")


def claimed_nodes(t: Tables) -> DataFrame:
    """Claims on all twelve types of node, with how many each row stands for; what many rows repeat is merged here."""
    c, seq, one = F.col, F.col("seq").cast("string"), F.lit(1)
    node = lambda df, prefix, key, kind, label, locator, n=one: df.select(_ref(prefix, key).alias("id"), F.lit(kind).alias("node_type"), label.alias("label"), locator.cast("string").alias("locator"), n.cast("long").alias("claims"))
    pages = t.turns.groupBy("group_id", _page(c("seq")).alias("page")).count()
    people = t.turns.groupBy("speaker").agg(F.min("turn_id").alias("turn_id"), F.count("*").alias("count"))
    titles = t.listed.where("there")
    return _union([
        node(t.bills, "bill", c("number"), "bill", c("name"), c("number")), node(t.bills.where("result is not null"), "status", c("number"), "bill_status", c("result"), c("number")),
        node(t.bill_texts, "text", c("doc_id"), "bill_text", c("source"), c("digest")), node(t.meetings, "meeting", c("group_id"), "meeting", c("committee"), c("url")),
        node(t.meetings, "minutes", c("group_id"), "minutes_document", c("kind"), c("url")), node(t.review_reports, "report", c("page_id"), "review_report", F.lit("review"), c("url")),
        node(pages, "page", F.concat_ws("/", c("group_id").cast("string"), c("page")), "document_page", c("page"), c("group_id"), c("count")), node(t.turns, "speech", c("turn_id"), "speech", c("role"), seq),
        node(people, "person", c("speaker"), "person", c("speaker"), c("turn_id"), c("count")), node(titles, "agenda", c("number"), "agenda", c("title"), c("half"), c("count")),
        node(t.turns.where("role = 'assistant'"), "response", c("turn_id"), "government_response", F.when(c("seq") % 2 == 1, "qa_response").otherwise("statement"), seq),
        node(t.raw("benchmark"), "issue", c("item_id"), "issue", F.left("text", F.lit(40)), c("item_id")),
    ])


@query("gr_nodes", f"WITH {NODES_SQL} SELECT * FROM nodes")
def gr_nodes(t: Tables) -> DataFrame:
    return evidence.merge_nodes(claimed_nodes(t))[0]


@query("gr_node_conflicts", f"WITH {NODES_SQL} SELECT id, versions, claims FROM merged WHERE versions > 1")
def gr_node_conflicts(t: Tables) -> DataFrame:
    return evidence.merge_nodes(claimed_nodes(t))[1]


#: What each issue refers to: the bill, agenda, document and turn that its number leads to; some do not exist.
ISSUES_SQL = """refs AS (SELECT item_id, unnest([{'kind': 'bill', 'ref': 'bill:' || lpad(CAST(item_id * 40 AS VARCHAR), 7, '0')}, {'kind': 'agenda', 'ref': 'agenda:' || lpad(CAST(item_id * 3 AS VARCHAR), 7, '0')}, {'kind': 'document', 'ref': 'text:' || CAST(item_id AS VARCHAR)}, {'kind': 'meeting', 'ref': 'meeting:' || CAST(item_id AS VARCHAR)},
    {'kind': 'turn', 'ref': 'speech:' || CAST(item_id AS VARCHAR) || ':speech-0001'}, {'kind': 'report', 'ref': 'report:' || CAST(item_id * 2 AS VARCHAR)}], recursive := true) FROM benchmark)"""


def issue_references(t: Tables) -> DataFrame:
    k = F.col("item_id")
    ref = lambda kind, to: F.struct(F.lit(kind).alias("kind"), to.alias("ref"))
    listed = F.array(
        ref("bill", _ref("bill", F.lpad((k * 40).cast("string"), 7, "0"))), ref("agenda", _ref("agenda", F.lpad((k * 3).cast("string"), 7, "0"))), ref("document", _ref("text", k)), ref("meeting", _ref("meeting", k)),
        ref("turn", F.concat(F.lit("speech:"), k.cast("string"), F.lit(":speech-0001"))), ref("report", _ref("report", k * 2)),
    )
    return t.raw("benchmark").select("item_id", F.explode(listed).alias("r")).select("item_id", "r.*")


EDGES_SQL = f"""{NODES_SQL}, {QA_SQL}, {ISSUES_SQL},
  follows AS (SELECT turn_id, seq, group_id, lead(turn_id) OVER (PARTITION BY group_id ORDER BY seq) AS next_id FROM turns),
  titled AS (SELECT DISTINCT 'speech:' || turn_id AS source, p_name || CASE WHEN seq % 5 = 3 THEN ' (draft)' ELSE '' END AS title FROM links JOIN part ON CAST(number AS BIGINT) = p_partkey WHERE link_type = 'AGENDA_MATCH'),
  labels AS (SELECT label, count(*) AS n, min(id) AS one FROM nodes WHERE node_type = 'agenda' GROUP BY 1),
  bound AS (SELECT source, CASE WHEN n = 1 THEN one ELSE 'agenda-title:' || title END AS target, coalesce(n, 0) > 1 AS ambiguous FROM titled LEFT JOIN labels ON label = title),
  claims AS (SELECT 'bill:' || number AS source, 'status:' || number AS target, 'has_status' AS edge_type, 'overlay' AS reason FROM entities
    UNION SELECT 'bill:' || number, 'text:' || CASE WHEN doc_id % 3 = 2 THEN 'lost-' ELSE '' END || CAST(doc_id AS VARCHAR), 'has_bill_text', lang FROM bill_texts UNION SELECT 'meeting:' || CAST(group_id AS VARCHAR), 'agenda:' || number, 'has_agenda', 'listed' FROM agenda
    UNION SELECT 'agenda:' || number, 'bill:' || number, 'agenda_for_bill', 'exact_number' FROM agenda UNION SELECT 'meeting:' || CAST(group_id AS VARCHAR), 'minutes:' || CASE WHEN group_id % 9 = 4 THEN 'lost-' ELSE '' END || CAST(group_id AS VARCHAR), 'has_minutes', 'url' FROM meetings
    UNION SELECT 'agenda:' || number, 'minutes:' || CAST(group_id AS VARCHAR), 'evidenced_by_minutes', 'meeting' FROM agenda UNION SELECT 'bill:' || number, 'report:' || CAST(page_id AS VARCHAR), 'has_review_report', 'url' FROM review_reports
    UNION SELECT 'minutes:' || CAST(group_id AS VARCHAR), 'page:' || CAST(group_id AS VARCHAR) || '/' || CAST(seq // 3 AS VARCHAR), 'has_page', 'locator' FROM turns UNION SELECT 'minutes:' || CAST(group_id AS VARCHAR), 'speech:' || turn_id, 'contains_speech', 'parsed' FROM turns
    UNION SELECT 'page:' || CASE WHEN group_id % 5 = 2 THEN 'lost-' ELSE '' END || CAST(group_id AS VARCHAR) || '/' || CAST(seq // 3 AS VARCHAR), 'speech:' || turn_id, 'page_contains_speech', 'locator' FROM turns UNION SELECT source, target, 'addresses_agenda', 'title' FROM bound WHERE NOT ambiguous
    UNION SELECT 'speech:' || turn_id, 'bill:' || number, 'discusses_bill', link_type FROM links UNION SELECT 'person:' || speaker, 'speech:' || turn_id, 'made_speech', 'speaker' FROM turns UNION SELECT 'response:' || turn_id, 'speech:' || turn_id, 'derived_from_speech', 'role' FROM turns WHERE role != 'system'
    UNION SELECT 'speech:' || source, 'speech:' || target, lower(relation), 'adjacent' FROM qa UNION SELECT 'speech:' || turn_id, 'speech:' || next_id, 'continues', 'page_break' FROM follows WHERE seq % 3 = 2 AND next_id IS NOT NULL
    UNION SELECT ref, 'issue:' || CAST(item_id AS VARCHAR), CASE WHEN kind IN ('bill', 'agenda', 'meeting') THEN 'has_issue' WHEN kind IN ('document', 'report') THEN 'identifies_issue' ELSE 'discusses_issue' END, kind FROM refs),
  marked0 AS (SELECT source, target, edge_type, reason, CASE WHEN a.id IS NULL AND b.id IS NULL THEN 'missing_both' WHEN a.id IS NULL THEN 'missing_source' WHEN b.id IS NULL THEN 'missing_target' END AS gap FROM claims LEFT JOIN nodes a ON a.id = source LEFT JOIN nodes b ON b.id = target),
  marked AS (SELECT * FROM marked0 UNION ALL SELECT DISTINCT source, target, 'addresses_agenda', 'title', 'ambiguous_target' FROM bound WHERE ambiguous)"""


def edge_claims(t: Tables, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims on all types of edge but those of ``keyed_claims``, and those that stay ambiguous; some name what does not exist."""
    lost = lambda wrong: F.when(wrong, "lost-").otherwise("")
    lit, c = F.lit, F.col
    edge = lambda df, source, target, kind, reason: df.select(source.alias("source"), target.alias("target"), kind.alias("edge_type"), reason.alias("reason"))
    bill, speech, meeting, minutes = _ref("bill", c("number")), _ref("speech", c("turn_id")), _ref("meeting", c("group_id")), _ref("minutes", c("group_id"))
    page = _ref("page", F.concat_ws("/", c("group_id").cast("string"), _page(c("seq"))))
    from dossier.operators.linking import adjacent

    follows = adjacent(t.turns.select("group_id", "seq", "turn_id", "text")).where((c("seq") % 3 == 2) & c("next").isNotNull())
    titled = t.links.where("link_type = 'AGENDA_MATCH'").join(t.raw("part"), c("number").cast("long") == c("p_partkey")).select(
        speech.alias("source"), F.concat("p_name", F.when(c("seq") % 5 == 3, " (draft)").otherwise("")).alias("title"), lit("addresses_agenda").alias("edge_type"), lit("title").alias("reason")
    )
    bound, ambiguous = evidence.by_title(titled, nodes, "agenda")
    issue_kind = F.when(c("kind").isin("bill", "agenda", "meeting"), "has_issue").when(c("kind").isin("document", "report"), "identifies_issue").otherwise("discusses_issue")
    claims = _union([
        edge(t.bill_texts, bill, _ref("text", F.concat(lost(c("doc_id") % 3 == 2), c("doc_id").cast("string"))), lit("has_bill_text"), c("lang")),
        edge(t.meetings, meeting, _ref("minutes", F.concat(lost(c("group_id") % 9 == 4), c("group_id").cast("string"))), lit("has_minutes"), lit("url")),
        edge(t.review_reports, bill, _ref("report", c("page_id")), lit("has_review_report"), lit("url")), edge(t.turns, minutes, page, lit("has_page"), lit("locator")),
        edge(t.turns, minutes, speech, lit("contains_speech"), lit("parsed")), edge(t.turns, _ref("page", F.concat(lost(c("group_id") % 5 == 2), F.concat_ws("/", c("group_id").cast("string"), _page(c("seq"))))), speech, lit("page_contains_speech"), lit("locator")), bound, edge(t.links, speech, bill, lit("discusses_bill"), c("link_type")),
        edge(t.turns, _ref("person", c("speaker")), speech, lit("made_speech"), lit("speaker")), edge(t.turns.where("role != 'system'"), _ref("response", c("turn_id")), speech, lit("derived_from_speech"), lit("role")),
        edge(relations(t), _ref("speech", c("source")), _ref("speech", c("target")), F.lower("relation"), lit("adjacent")), edge(follows, speech, _ref("speech", c("next")), lit("continues"), lit("page_break")),
        edge(issue_references(t), c("ref"), _ref("issue", c("item_id")), issue_kind, c("kind")),
    ])
    return claims, ambiguous


def keyed_claims(t: Tables, nodes: DataFrame) -> DataFrame:
    """The claims that tables of keys make, most of all: of entities and of agenda rows, with their gaps."""
    numbers = t.listed.where("there").select("number")
    own = evidence.mark_one_key([(t.bills.select("number"), ("bill", "status", "has_status", "overlay")), (numbers, ("agenda", "bill", "agenda_for_bill", "exact_number"))], nodes)
    pairs = evidence.mark_pairs(t.listed_pairs, [("meeting", "agenda", "has_agenda", "listed", False), ("agenda", "minutes", "evidenced_by_minutes", "meeting", True)], nodes, distinct=True)
    return own.unionByName(pairs)


def marked(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Nodes, and every claim once with its gap, the ambiguous ones among them."""
    nodes = written(gr_nodes(t), "nodes")
    claims, ambiguous = edge_claims(t, nodes)
    return nodes, evidence.mark_edges(claims, nodes).unionByName(keyed_claims(t, nodes)).unionByName(ambiguous)


def resolved(t: Tables) -> tuple[DataFrame, DataFrame]:
    return evidence.split(marked(t)[1])


@query("gr_edges", f"WITH {EDGES_SQL} SELECT source, target, edge_type, reason FROM marked WHERE gap IS NULL")
def gr_edges(t: Tables) -> DataFrame:
    return resolved(t)[0]


@query("gr_unresolved", f"WITH {EDGES_SQL} SELECT * FROM marked WHERE gap IS NOT NULL")
def gr_unresolved(t: Tables) -> DataFrame:
    """Claims with a missing or an ambiguous end, each with its gap."""
    return resolved(t)[1]


@query("gr_responses", f"WITH {QA_SQL}, touched AS (SELECT source AS turn_id FROM qa WHERE relation = 'ANSWER_TO' UNION SELECT target FROM qa WHERE relation = 'QUESTION_TO') SELECT t.turn_id, CASE WHEN x.turn_id IS NOT NULL THEN 'qa_response' ELSE 'statement' END AS label FROM turns t LEFT JOIN touched x ON x.turn_id = t.turn_id WHERE role = 'assistant'")
def gr_responses(t: Tables) -> DataFrame:
    qa = relations(t)
    touched = qa.where("relation = 'ANSWER_TO'").select(F.col("source").alias("turn_id")).unionByName(qa.where("relation = 'QUESTION_TO'").select(F.col("target").alias("turn_id"))).distinct().withColumn("qa", F.lit(True))
    return t.turns.where("role = 'assistant'").select("turn_id").join(touched, "turn_id", "left").select("turn_id", F.when(F.col("qa"), "qa_response").otherwise("statement").alias("label"))


@query("gr_page_links", "WITH p AS (SELECT group_id, seq // 3 + CASE WHEN group_id % 5 = 2 THEN 1 ELSE 0 END AS page, count(*) AS n FROM turns GROUP BY 1, 2), l AS (SELECT turn_id, group_id, unnest(CASE WHEN seq % 3 = 2 THEN [seq // 3, seq // 3 + 1] ELSE [seq // 3] END) AS page FROM turns) SELECT turn_id, l.page, CASE WHEN n IS NULL THEN 'missing' WHEN n > 3 THEN 'ambiguous' ELSE 'linked' END AS status FROM l LEFT JOIN p USING (group_id, page)")
def gr_page_links(t: Tables) -> DataFrame:
    """Locators such as "0|1" are taken apart and each part looked up among the pages, which some groups number from one on."""
    page = F.floor(F.col("seq") / 3)
    known = t.turns.groupBy("group_id", (page + F.when(F.col("group_id") % 5 == 2, 1).otherwise(0)).alias("page")).agg(F.count("*").alias("n"))
    locator = F.when(F.col("seq") % 3 == 2, F.concat(page.cast("string"), F.lit("|"), (page + 1).cast("string"))).otherwise(page.cast("string"))
    parts = t.turns.select("turn_id", "group_id", F.explode(F.transform(F.split(locator, r"\|"), lambda p: p.cast("long"))).alias("page"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 3, "ambiguous").otherwise("linked")
    return parts.join(known, ["group_id", "page"], "left").select("turn_id", "page", status.alias("status"))


@query("gr_issue_links", f"WITH {NODES_SQL}, {ISSUES_SQL} SELECT item_id, kind, ref, node_type, id IS NOT NULL AS linked FROM refs LEFT JOIN nodes ON id = ref")
def gr_issue_links(t: Tables) -> DataFrame:
    """Every reference of every issue, linked to the node it names or not."""
    known = gr_nodes(t).select(F.col("id").alias("ref"), "node_type")
    return issue_references(t).join(known, "ref", "left").select("item_id", "kind", "ref", "node_type", F.col("node_type").isNotNull().alias("linked"))


COUNTS_SQL = f"""{EDGES_SQL}, parts AS (SELECT 'node' AS part, node_type AS type, id || chr(31) || node_type || chr(31) || label AS content FROM nodes UNION ALL SELECT 'edge', edge_type, source || chr(31) || target || chr(31) || edge_type FROM marked WHERE gap IS NULL
    UNION ALL SELECT 'unresolved', edge_type, source || chr(31) || target || chr(31) || edge_type FROM marked WHERE gap IS NOT NULL UNION ALL SELECT 'gap', gap, source || chr(31) || target || chr(31) || gap FROM marked WHERE gap IS NOT NULL)"""


@query("gr_counts_hash", f"WITH {COUNTS_SQL} SELECT part, type, count(*) AS n, bit_xor(CAST('0x' || sha256(content)[1:15] AS BIGINT)) AS xored FROM parts GROUP BY 1, 2")
def gr_counts_hash(t: Tables) -> DataFrame:
    """Nodes, edges, unresolved claims and gaps by type, each with a fingerprint that no order changes."""
    nodes, claims = marked(t)
    content = lambda *cols: F.concat_ws("\u001f", *cols)
    part = lambda name, kind, told: F.struct(F.lit(name).alias("part"), F.col(kind).alias("type"), told.alias("content"))
    told, gap = content("source", "target", "edge_type"), content("source", "target", "gap")
    each = F.when(F.col("gap").isNull(), F.array(part("edge", "edge_type", told))).otherwise(F.array(part("unresolved", "edge_type", told), part("gap", "gap", gap)))
    own = nodes.select(part("node", "node_type", content("id", "node_type", "label")).alias("p"))
    parts = own.unionByName(claims.select(F.explode(each).alias("p"))).select("p.*")
    digest = F.conv(F.substring(F.sha2("content", 256), 1, 15), 16, 10).cast("long")
    return parts.groupBy("part", "type").agg(F.count("*").alias("n"), F.bit_xor(digest).alias("xored"))


#: The nine axes of evidence as one table.
RECORDS_SQL = """
  cited AS (SELECT t.*, m.url || '#' || CAST(seq AS VARCHAR) AS citation FROM turns t JOIN meetings m USING (group_id)), linked AS (SELECT DISTINCT turn_id FROM links),
  near AS (SELECT DISTINCT c.turn_id FROM cited c JOIN turns h ON h.group_id = c.group_id AND abs(h.seq - c.seq) = 1 JOIN linked l ON l.turn_id = h.turn_id WHERE c.turn_id NOT IN (SELECT turn_id FROM linked)),
  records AS (SELECT 'bills' AS evidence_type, number AS id, CAST(proposed_at AS VARCHAR) AS sort_key, name AS title, number, CAST(NULL AS BIGINT) AS meeting, 'https://bills.example.org/' || number AS citation, 'committee=' || committee AS metadata FROM entities
    UNION ALL SELECT 'bill_text', CAST(doc_id AS VARCHAR), source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0'), lang, number, NULL, 'sha256:' || digest[1:16], 'source=' || source FROM bill_texts
    UNION ALL SELECT 'bill_status', number, CAST(processed_at AS VARCHAR), result, number, NULL, 'https://bills.example.org/' || number || '/status', 'term=' || CAST(term AS VARCHAR) FROM entities WHERE result IS NOT NULL
    UNION ALL SELECT 'agendas', CAST(group_id AS VARCHAR) || '/' || CAST(seq AS VARCHAR), CAST(listed_on AS VARCHAR), title, number, group_id, 'https://records.example.org/agenda?id=' || CAST(group_id AS VARCHAR), 'proposer=' || proposer FROM agenda
    UNION ALL SELECT 'subcommittee_minutes', CAST(group_id AS VARCHAR), CAST(held_on AS VARCHAR), committee, NULL, group_id, url, 'term=' || CAST(term AS VARCHAR) FROM meetings WHERE kind = 'subcommittee' UNION ALL SELECT 'review_reports', CAST(page_id AS VARCHAR), url, 'review', number, NULL, url, 'page=' || CAST(page_id AS VARCHAR) FROM review_reports
    UNION ALL SELECT 'speeches', turn_id, CAST(held_on AS VARCHAR), role, NULL, group_id, citation, 'speaker=' || speaker FROM cited WHERE turn_id IN (SELECT turn_id FROM linked) UNION ALL SELECT 'speech_context', turn_id, CAST(held_on AS VARCHAR), role, NULL, group_id, citation, 'speaker=' || speaker FROM cited WHERE turn_id IN (SELECT turn_id FROM near)
    UNION ALL SELECT 'government_responses', turn_id, CAST(held_on AS VARCHAR), role, NULL, group_id, citation, 'organization=' || organization FROM cited WHERE role = 'assistant')"""


BILLS_URL = "https://bills.example.org/"


def _record(df: DataFrame, kind: str, key: Column, sort_key: Column, title: Column, number: Column | None, meeting: Column | None, citation: Column, told: str) -> DataFrame:
    lit = F.lit
    number, meeting = lit(None) if number is None else number, lit(None) if meeting is None else meeting
    return df.select(
        lit(kind).alias("evidence_type"), key.cast("string").alias("id"), sort_key.cast("string").alias("sort_key"), title.alias("title"), number.cast("string").alias("number"), meeting.cast("long").alias("meeting"), citation.alias("citation"),
        F.concat(lit((told if told != "page_id" else "page") + "="), F.col(told).cast("string")).alias("metadata"),
    )


def text_records(t: Tables) -> DataFrame:
    """The records of ``evidence_records`` that documents, pages and turns give."""
    c, lit = F.col, F.lit
    cited = t.turns.join(t.meetings.select("group_id", "url"), "group_id").withColumn("citation", F.concat("url", lit("#"), c("seq").cast("string")))
    linked = t.links.select("turn_id", "group_id", "seq").distinct()
    beside = linked.select("group_id", F.explode(F.array(c("seq") - 1, c("seq") + 1)).alias("seq")).distinct()
    near = cited.join(beside, ["group_id", "seq"], "left_semi").join(linked, "turn_id", "left_anti")
    group = c("group_id")
    return _union([
        _record(t.bill_texts, "bill_text", c("doc_id"), F.concat("source", lit("/"), F.lpad(c("doc_id").cast("string"), 12, "0")), c("lang"), c("number"), None, F.concat(lit("sha256:"), F.left("digest", lit(16))), "source"),
        _record(t.meetings.where("kind = 'subcommittee'"), "subcommittee_minutes", group, c("held_on"), c("committee"), None, group, c("url"), "term"), _record(t.review_reports, "review_reports", c("page_id"), c("url"), lit("review"), c("number"), None, c("url"), "page_id"),
        _record(cited.join(linked, "turn_id", "left_semi"), "speeches", c("turn_id"), c("held_on"), c("role"), None, group, c("citation"), "speaker"), _record(near, "speech_context", c("turn_id"), c("held_on"), c("role"), None, group, c("citation"), "speaker"),
        _record(cited.where("role = 'assistant'"), "government_responses", c("turn_id"), c("held_on"), c("role"), None, group, c("citation"), "organization"),
    ])


def evidence_records(t: Tables) -> DataFrame:
    """Every piece of evidence: axis, id, sort key, title, the bill and meeting it names, citation and metadata."""
    c, lit = F.col, F.lit
    group, bills = c("group_id"), lit(BILLS_URL)
    return _union([
        _record(t.entities, "bills", c("number"), c("proposed_at"), c("name"), c("number"), None, F.concat(bills, "number"), "committee"),
        _record(t.entities.where("result is not null"), "bill_status", c("number"), c("processed_at"), c("result"), c("number"), None, F.concat(bills, "number", lit("/status")), "term"),
        _record(t.agenda, "agendas", F.concat_ws("/", group.cast("string"), c("seq").cast("string")), c("listed_on"), c("title"), c("number"), group, F.concat(lit("https://records.example.org/agenda?id="), group.cast("string")), "proposer"),
        text_records(t),
    ])


def placed_records(t: Tables) -> DataFrame:
    """Records with their place on their axis; rows of one sort key are ordered in one task, not those of one axis."""
    return search.ranked_within(evidence_records(t), "evidence_type", [F.asc("sort_key"), F.asc("id")]).withColumnRenamed("rank", "place")


@query("gr_evidence_records", f"WITH {RECORDS_SQL} SELECT *, row_number() OVER (PARTITION BY evidence_type ORDER BY sort_key, id) AS place FROM records")
def gr_evidence_records(t: Tables) -> DataFrame:
    return placed_records(t)


@query("gr_fingerprint", f"WITH {RECORDS_SQL}, d AS (SELECT CAST('0x' || sha256(evidence_type || chr(31) || id || chr(31) || sort_key)[1:15] AS BIGINT) AS d FROM records) SELECT count(*) AS n_rows, bit_xor(d) AS xored, CAST(sum(d % 1000003) AS BIGINT) AS summed FROM d")
def gr_fingerprint(t: Tables) -> DataFrame:
    return corpus.table_fingerprint(evidence_records(t), ["evidence_type", "id", "sort_key"])
