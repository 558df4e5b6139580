"""Join and link queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.catalog.searching import bm25_sql
from dossier.operators import gate, linking, search
from dossier.registry import query
from dossier.views import Tables


@query("jn_context", "SELECT h.turn_id AS hit, t.turn_id, t.seq - h.seq AS delta, t.role FROM turns h JOIN turns t ON h.group_id = t.group_id AND t.seq BETWEEN h.seq - 1 AND h.seq + 2")
def jn_context(t: Tables) -> DataFrame:
    return linking.context(t.turns, t.turns, 1, 2)


@query("jn_adjacent", "SELECT turn_id, lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text FROM turns WINDOW w AS (PARTITION BY group_id ORDER BY seq)")
def jn_adjacent(t: Tables) -> DataFrame:
    return linking.adjacent(t.turns).select("turn_id", "previous_text", "next_text")


@query("wn_prev_next", "SELECT turn_id, lag(turn_id) OVER w AS previous, lead(turn_id) OVER w AS next FROM turns WINDOW w AS (PARTITION BY group_id ORDER BY seq)")
def wn_prev_next(t: Tables) -> DataFrame:
    return linking.adjacent(t.turns).select("turn_id", "previous", "next")


QA_SQL = """
  seen AS (SELECT turn_id, group_id, role, role = 'user' AS asks, lead(turn_id) OVER w AS n1, lead(role) OVER w AS r1, lead(turn_id, 2) OVER w AS n2, lead(role, 2) OVER w AS r2 FROM turns WINDOW w AS (PARTITION BY group_id ORDER BY seq)),
  qa AS (SELECT turn_id AS source, n1 AS target, 'QUESTION_TO' AS relation, 0.9::DOUBLE AS confidence FROM seen WHERE asks AND r1 = 'assistant'
    UNION ALL SELECT n1, turn_id, 'ANSWER_TO', 0.9::DOUBLE FROM seen WHERE asks AND r1 = 'assistant'
    UNION ALL SELECT n2, turn_id, 'FOLLOW_UP_TO', 0.8::DOUBLE FROM seen WHERE asks AND r1 = 'assistant' AND r2 = 'user')"""


def relations(t: Tables) -> DataFrame:
    """The supplied turns have no question mark; a user's turn asks and an assistant's answers."""
    return linking.question_answer_relations(t.turns, F.col("role") == "user", ["assistant"])


@query("jn_qa_relations", f"WITH {QA_SQL} SELECT * FROM qa")
def jn_qa_relations(t: Tables) -> DataFrame:
    return relations(t)


@query("jn_explicit_mentions", "WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 17 = 3 THEN ' (no. ' || lpad(CAST(doc_id % 50 AS VARCHAR), 7, '0') || '1)' ELSE '' END AS text FROM documents), b AS (SELECT item_id, lpad(CAST(item_id AS VARCHAR), 7, '0') AS number, text AS name FROM benchmark) SELECT doc_id, item_id, CASE WHEN contains(d.text, number) THEN number ELSE name END AS evidence, 1.0::DOUBLE AS confidence FROM d JOIN b ON contains(d.text, number) OR (length(name) >= 4 AND contains(d.text, name))")
def jn_explicit_mentions(t: Tables) -> DataFrame:
    """Documents that hold an item's number, even within longer digits, or its whole text."""
    cited = F.when(F.col("doc_id") % 17 == 3, F.concat(F.lit(" (no. "), F.lpad((F.col("doc_id") % 50).cast("string"), 7, "0"), F.lit("1)"))).otherwise("")
    items = t.raw("benchmark").select("item_id", F.lpad(F.col("item_id").cast("string"), 7, "0").alias("number"), F.col("text").alias("name"))
    return linking.explicit_mentions(t.raw("documents").select("doc_id", F.concat("text", cited).alias("text")), items, "doc_id", "item_id")


@query("jn_hydrate", "SELECT turn_id, role, m.kind, m.url || '#' || CAST(seq AS VARCHAR) AS citation, m.held_on FROM turns JOIN meetings m USING (group_id)")
def jn_hydrate(t: Tables) -> DataFrame:
    joined = t.turns.select("turn_id", "role", "seq", "group_id").join(t.meetings, "group_id")
    return joined.select("turn_id", "role", "kind", F.concat("url", F.lit("#"), F.col("seq").cast("string")).alias("citation"), "held_on")


@query("jn_related_turns", "SELECT number, turn_id, confidence, row_number() OVER (PARTITION BY number ORDER BY confidence DESC, held_on DESC, turn_id) AS rank FROM links JOIN entities USING (number)")
def jn_related_turns(t: Tables) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("confidence"), F.desc("held_on"), "turn_id")
    return t.links.join(t.entities.select("number"), "number").select("number", "turn_id", "confidence", F.row_number().over(order).cast("long").alias("rank"))


@query("jn_linked_entities", "WITH r AS (SELECT group_id, number, confidence, proposed_at, row_number() OVER (PARTITION BY group_id, number ORDER BY confidence DESC, proposed_at, number) AS k FROM links JOIN entities USING (number)) SELECT group_id, number, confidence, proposed_at FROM r WHERE k = 1")
def jn_linked_entities(t: Tables) -> DataFrame:
    """Distinct linked entities of each group, the best link each: a grouped maximum."""
    best = t.links.groupBy("group_id", "number").agg(F.max("confidence").alias("confidence"))
    return best.join(t.entities.select("number", "proposed_at"), "number").select("group_id", "number", "confidence", "proposed_at")


ROLE_SQL = """
  wanted AS (SELECT DISTINCT s_suppkey % 20 AS query_id, ['representative', 'co', 'any'][s_suppkey % 3 + 1] AS role, s_name AS name FROM supplier),
  own AS (SELECT group_id AS candidate, proposer AS name, bool_or(seq = 1) AS leads, bool_or(seq != 1) AS joins FROM agenda GROUP BY 1, 2),
  hits AS (SELECT query_id, candidate, role, w.name, leads, CASE role WHEN 'representative' THEN leads WHEN 'co' THEN joins ELSE true END AS fits FROM own o JOIN wanted w ON o.name = w.name),
  met AS (SELECT query_id, candidate, list(DISTINCT role) FILTER (WHERE fits) AS met, count(*) FILTER (WHERE fits) AS names, string_agg(DISTINCT 'proposer:' || CASE WHEN role != 'any' THEN role WHEN leads THEN 'representative' ELSE 'co' END || ':' || name, ',' ORDER BY 'proposer:' || CASE WHEN role != 'any' THEN role WHEN leads THEN 'representative' ELSE 'co' END || ':' || name) FILTER (WHERE fits) AS reasons FROM hits GROUP BY 1, 2),
  roles AS (SELECT query_id, list(DISTINCT role) AS roles FROM wanted GROUP BY 1)"""


@query("jn_role_match", f"WITH {ROLE_SQL}, m AS (SELECT *, list_filter(['representative', 'co', 'any'], lambda r: list_contains(roles, r) AND NOT list_contains(coalesce(met, []), r))[1] AS missing FROM met JOIN roles USING (query_id)) SELECT query_id, candidate, missing IS NULL AS all_met, names, missing, coalesce(reasons, '') AS reasons FROM m")
def jn_role_match(t: Tables) -> DataFrame:
    """The first proposer of an agenda represents it, the others support it; queries ask for names by role, every role to be met."""
    wanted = t.raw("supplier").select((F.col("s_suppkey") % 20).alias("query_id"), F.get(F.lit(gate.ROLES), (F.col("s_suppkey") % 3).cast("int")).alias("role"), F.col("s_name").alias("name"))
    offered = t.agenda.select(F.col("group_id").alias("candidate"), F.when(F.col("seq") == 1, "representative").otherwise("co").alias("role"), F.col("proposer").alias("name"))
    return gate.match_proposers(offered, wanted)


@query("jn_semi_by_number", "SELECT group_id, bool_or(number IN (SELECT number FROM entities WHERE result IS NOT NULL)) AS admitted, CASE WHEN NOT bool_or(number IN (SELECT number FROM entities WHERE result IS NOT NULL)) THEN 'no_selected_proposer_bill' END AS reason FROM agenda GROUP BY 1")
def jn_semi_by_number(t: Tables) -> DataFrame:
    return linking.admit_by_number(t.agenda.select("group_id", "number"), t.entities.where("result is not null"), "group_id")


@query("jn_required_exact", "SELECT DISTINCT number FROM agenda WHERE number NOT IN (SELECT number FROM entities WHERE committee = 'BUILDING')")
def jn_required_exact(t: Tables) -> DataFrame:
    return t.agenda.select("number").distinct().join(t.entities.where("committee = 'BUILDING'"), "number", "left_anti")


MAPPING_SQL = """
  cand AS (SELECT doc_id // 3 AS identity, doc_id, CASE WHEN doc_id % 11 = 0 THEN 'moved' ELSE source END AS url, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS copy FROM documents),
  work AS (SELECT CASE WHEN doc_id % 4 = 1 THEN doc_id // 3 ELSE doc_id + 1 END AS identity, count(*) AS targets, min(source) AS url FROM documents GROUP BY 1)"""


@query("jn_exact_mapping", f"WITH {MAPPING_SQL} SELECT doc_id, CASE WHEN copy > 1 THEN 'duplicate' WHEN targets IS NULL THEN 'unmapped' WHEN targets > 1 THEN 'ambiguous' WHEN c.url != w.url THEN 'url_mismatch' ELSE 'mapped' END AS outcome FROM cand c LEFT JOIN work w USING (identity)")
def jn_exact_mapping(t: Tables) -> DataFrame:
    docs = t.raw("documents")
    candidates = docs.select(F.floor(F.col("doc_id") / 3).cast("long").alias("identity"), "doc_id", F.when(F.col("doc_id") % 11 == 0, "moved").otherwise(F.col("source")).alias("url"))
    work = docs.select(F.when(F.col("doc_id") % 4 == 1, F.floor(F.col("doc_id") / 3).cast("long")).otherwise(F.col("doc_id") + 1).alias("identity"), F.col("source").alias("url"))
    return linking.exact_mapping(candidates, work, [F.asc("doc_id")]).select("doc_id", "outcome")


@query(
    "jn_title_binding",
    """WITH asked AS (SELECT l_orderkey AS group_id, l_linenumber AS k, p_name AS title, CASE WHEN l_partkey % 3 = 0 THEN lpad(CAST(l_partkey AS VARCHAR), 7, '0') END AS asked_number, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT a.group_id, CAST(k AS BIGINT) AS k, a.title, l_suppkey, CASE WHEN count(*) FILTER (WHERE number = asked_number) = 1 THEN 'bound' WHEN count(*) FILTER (WHERE number = asked_number) > 1 THEN 'ambiguous' ELSE 'inferred_unresolved' END AS status, count(*) AS titles
    FROM asked a JOIN agenda g ON a.group_id = g.group_id AND a.title = g.title GROUP BY a.group_id, k, a.title, l_suppkey, asked_number""",
)
def jn_title_binding(t: Tables) -> DataFrame:
    """A turn is bound to an agenda item only if the title is equal and the exact number agrees on one."""
    number = F.when(F.col("l_partkey") % 3 == 0, F.lpad(F.col("l_partkey").cast("string"), 7, "0"))
    asked = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").cast("long").alias("k"), F.col("p_name").alias("title"), number.alias("number"), "l_suppkey"
    )
    return linking.bind_titles(asked, t.agenda, ["group_id", "k", "l_suppkey"]).select("group_id", "k", "title", "l_suppkey", "status", "titles")


@query(
    "jn_status_overlay",
    """WITH s AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 7, '0') AS number, CASE WHEN l_linestatus = 'F' THEN 'processed' WHEN l_returnflag = 'A' THEN 'withdrawn' ELSE ' ' END AS result, CASE WHEN l_linenumber % 2 = 0 THEN 'desk ' || CAST(l_suppkey % 3 AS VARCHAR) END AS committee, l_returnflag AS stage, (l_shipdate, l_linenumber, l_partkey, l_suppkey) AS ord FROM lineitem),
    o AS (SELECT number, max_by(result, ord) FILTER (WHERE trim(result) != '') AS result, max_by(stage, ord) AS stage, min_by(committee, ord) FILTER (WHERE committee IS NOT NULL) AS committee, concat_ws(',', CASE WHEN count(DISTINCT nullif(trim(result), '')) > 1 THEN 'result' END, CASE WHEN count(DISTINCT stage) > 1 THEN 'stage' END) AS conflicts FROM s GROUP BY 1)
    SELECT number, coalesce(CASE WHEN e.committee != 'BUILDING' THEN e.committee END, o.committee) AS committee, coalesce(o.result, e.result) AS result, o.stage, coalesce(conflicts, '') AS conflicts FROM entities e LEFT JOIN o USING (number)""",
)
def jn_status_overlay(t: Tables) -> DataFrame:
    """Status rows fill a blank committee and overwrite result and stage; where they differ is a conflict."""
    result = F.when(F.col("l_linestatus") == "F", "processed").when(F.col("l_returnflag") == "A", "withdrawn").otherwise(" ")
    rows = t.raw("lineitem").select(
        F.lpad(F.col("l_orderkey").cast("string"), 7, "0").alias("number"), result.alias("result"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("desk "), (F.col("l_suppkey") % 3).cast("string"))).alias("committee"), F.col("l_returnflag").alias("stage"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
    )
    own = t.entities.select("number", F.when(F.col("committee") != "BUILDING", F.col("committee")).otherwise(" ").alias("committee"), "result", F.lit(None).cast("string").alias("stage"))
    return linking.overlay_status(own, rows, F.col("ord"), ["committee"], ["result", "stage"])


@query("jn_agenda_gaps", "WITH a AS (SELECT group_id, seq, title || CASE WHEN seq % 7 = 6 THEN ' (new)' ELSE '' END AS title FROM agenda), e AS (SELECT p_name || CASE WHEN p_size > 45 THEN '' WHEN p_size > 20 THEN ' (old)' ELSE ' (draft)' END AS title, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1) SELECT group_id, seq, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'inferred_unresolved' ELSE 'ambiguous' END AS gap FROM a LEFT JOIN e USING (title)")
def jn_agenda_gaps(t: Tables) -> DataFrame:
    """An item without a number is looked up by its title among the parts; those of small size go by other titles."""
    items = t.agenda.select("group_id", "seq", F.concat("title", F.when(F.col("seq") % 7 == 6, " (new)").otherwise("")).alias("title"))
    title = F.concat("p_name", F.when(F.col("p_size") > 45, "").when(F.col("p_size") > 20, " (old)").otherwise(" (draft)"))
    accepted = t.raw("part").select(title.alias("title"), F.col("p_partkey").alias("number"))
    return linking.title_gaps(items, accepted).select("group_id", "seq", "gap")


@query(
    "jn_document_binding",
    """WITH d AS (SELECT doc_id, 'https://records.example.org/minutes?id=' || CAST(doc_id % 300 AS VARCHAR) AS url, CASE WHEN doc_id % 4 = 1 THEN [lpad(CAST(doc_id AS VARCHAR), 7, '0')] ELSE [] END AS own FROM documents), m0 AS (SELECT group_id, CASE WHEN group_id % 10 = 7 THEN regexp_replace(url, '[0-9]$', '6') ELSE url END AS url FROM meetings), m AS (SELECT url, count(DISTINCT group_id) AS n, min(group_id) AS group_id FROM m0 GROUP BY 1),
    g AS (SELECT group_id, list(DISTINCT number) AS numbers FROM agenda GROUP BY 1)
    SELECT doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'bound' END AS status, CASE WHEN n = 1 THEN array_to_string(list_sort(list_distinct(list_concat(own, coalesce(numbers, [])))), ',') END AS numbers FROM d LEFT JOIN m USING (url) LEFT JOIN g USING (group_id)""",
)
def jn_document_binding(t: Tables) -> DataFrame:
    """Some meetings share an address, some documents have a number of their own."""
    k = F.col("doc_id")
    own = F.when(k % 4 == 1, F.array(F.lpad(k.cast("string"), 7, "0")))
    docs = t.raw("documents").select("doc_id", F.concat(F.lit("https://records.example.org/minutes?id="), (k % 300).cast("string")).alias("url"), own.alias("numbers"))
    meetings = t.meetings.select("group_id", F.when(F.col("group_id") % 10 == 7, F.regexp_replace("url", "[0-9]$", "6")).otherwise(F.col("url")).alias("url"))
    return linking.bind_documents(docs, meetings, t.agenda.select("group_id", "number")).select("doc_id", "status", F.array_join("numbers", ",").alias("numbers"))


@query("jn_entity_links", "SELECT number, turn_id, link_type, confidence FROM links WHERE number IN (SELECT number FROM entities WHERE result IS NOT NULL)")
def jn_entity_links(t: Tables) -> DataFrame:
    return t.links.join(t.entities.where("result is not null"), "number", "left_semi").select("number", "turn_id", "link_type", "confidence")


#: Conversations dealt to 25 queries; every second query asks for the numbers that its first turns are linked to.
ENFORCE_SQL = """
  t0 AS (SELECT group_id % 25 AS query_id, turn_id, group_id, seq, held_on FROM turns), l0 AS (SELECT DISTINCT group_id % 25 AS query_id, number, turn_id FROM links), e0 AS (SELECT DISTINCT query_id, number FROM l0 JOIN entities USING (number)),
  i0 AS (SELECT query_id, number, event FROM e0 JOIN (SELECT number, 'proposed' AS event FROM entities UNION ALL SELECT number, 'processed' FROM entities WHERE result IS NOT NULL) USING (number)), n0 AS (SELECT query_id, number, count(*) AS items FROM e0 JOIN agenda USING (number) GROUP BY 1, 2),
  wanted AS (SELECT DISTINCT group_id % 25 AS query_id, number FROM links WHERE seq = 1 AND group_id % 2 = 0 AND group_id % 25 % 2 = 0), asked AS (SELECT DISTINCT query_id FROM wanted),
  e AS (SELECT * FROM e0 WHERE query_id NOT IN (SELECT query_id FROM asked) OR (query_id, number) IN (SELECT (query_id, number) FROM wanted)), l AS (SELECT * FROM l0 WHERE query_id NOT IN (SELECT query_id FROM asked) OR (query_id, number) IN (SELECT (query_id, number) FROM e)),
  t AS (SELECT * FROM t0 WHERE query_id NOT IN (SELECT query_id FROM asked) OR (query_id, turn_id) IN (SELECT (query_id, turn_id) FROM l)), i AS (SELECT * FROM i0 WHERE query_id NOT IN (SELECT query_id FROM asked) OR (query_id, number) IN (SELECT (query_id, number) FROM e)),
  n AS (SELECT * FROM n0 WHERE query_id NOT IN (SELECT query_id FROM asked) OR (query_id, number) IN (SELECT (query_id, number) FROM e)),
  th AS (SELECT query_id, group_id, coalesce(CAST(seq - lag(seq) OVER (PARTITION BY query_id, group_id ORDER BY seq) > 1 AS INT), 1) AS starts FROM t)"""


@query("jn_exact_enforce", f"WITH {ENFORCE_SQL} SELECT query_id, part, n FROM (SELECT query_id, 'entities' AS part, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT query_id, 'links', count(*) FROM l GROUP BY 1 UNION ALL SELECT query_id, 'turns', count(*) FROM t GROUP BY 1 UNION ALL SELECT query_id, 'timeline', count(*) FROM i GROUP BY 1 UNION ALL SELECT query_id, 'inventory', CAST(sum(items) AS BIGINT) FROM n GROUP BY 1 UNION ALL SELECT query_id, 'threads', CAST(sum(starts) AS BIGINT) FROM th GROUP BY 1)")
def jn_exact_enforce(t: Tables) -> DataFrame:
    """Entities, links, turns, threads, timeline and inventories of each query, cut down to what its exact numbers reach."""
    k = (F.col("group_id") % 25).alias("query_id")
    turns = t.turns.select(k, "turn_id", "group_id", "seq")
    links = t.links.select(k, "number", "turn_id").distinct()
    entities = links.select("query_id", "number").distinct().join(t.entities.select("number"), "number", "left_semi")
    events = t.entities.select("number", F.lit("proposed").alias("event")).unionByName(t.entities.where("result is not null").select("number", F.lit("processed").alias("event")))
    inventory = entities.join(t.agenda.select("number"), "number").groupBy("query_id", "number").agg(F.count("*").alias("items"))
    wanted = t.links.where("seq = 1 and group_id % 2 = 0 and group_id % 25 % 2 = 0").select(k, "number").distinct()
    kept = linking.enforce_exact(wanted, entities, links, turns, entities.join(events, "number"), inventory)
    starts = F.coalesce((F.col("seq") - F.lag("seq").over(Window.partitionBy("query_id", "group_id").orderBy("seq")) > 1).cast("int"), F.lit(1))
    count = lambda name: kept[name].groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit(name).alias("part"), "n")
    total = lambda df, name, of: df.groupBy("query_id").agg(F.sum(of).alias("n")).select("query_id", F.lit(name).alias("part"), "n")
    parts = [*map(count, ("entities", "links", "turns", "timeline")), total(kept["inventory"], "inventory", "items"), total(kept["turns"].withColumn("starts", starts), "threads", "starts")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "wn_threads",
    f"""WITH {bm25_sql()}, hits AS (SELECT DISTINCT group_id, seq FROM ranked JOIN turns USING (turn_id) WHERE rank <= 10),
    f AS (SELECT group_id, seq, coalesce(CAST(seq - lag(seq) OVER (PARTITION BY group_id ORDER BY seq) > 3 AS INT), 1) AS new FROM hits), n AS (SELECT *, sum(new) OVER (PARTITION BY group_id ORDER BY seq) AS thread FROM f),
    s AS (SELECT group_id, thread, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_hits FROM n GROUP BY 1, 2),
    j AS (SELECT s.*, t.seq AS pos, t.role FROM s JOIN turns t ON t.group_id = s.group_id AND t.seq BETWEEN first_seq - 2 AND last_seq + 2), p AS (SELECT group_id, thread, role, min(pos) AS first_at FROM j GROUP BY 1, 2, 3),
    q AS (SELECT group_id, thread, string_agg(role, ',' ORDER BY first_at) AS participants FROM p GROUP BY 1, 2)
    SELECT j.group_id, CAST(j.thread AS BIGINT) AS thread, first_seq, last_seq, n_hits, participants, count(*) AS n_turns FROM j JOIN q ON j.group_id = q.group_id AND j.thread = q.thread GROUP BY ALL""",
)
def wn_threads(t: Tables) -> DataFrame:
    """The ten best turns of each benchmark text are the hits."""
    hits = search.bm25(t.indexed("turns"), t.query_words, 10).select("turn_id").distinct().join(t.turns, "turn_id")
    return linking.threads(hits, t.turns, gap=3)
