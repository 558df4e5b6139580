"""Search, ranking and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import LATIN_SUFFIXES, match_key, tokens
from dossier.operators import gate, index, search, vectors
from dossier.registry import query
from dossier.scratch import written
from dossier.views import Tables

def bm25_sql(where: str = "TRUE") -> str:
    """CTEs up to ``ranked``; only turns that meet ``where`` are scored."""
    return f"""
  totals AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM (SELECT turn_id, sum(tf) AS dl FROM turn_words GROUP BY 1)),
  sizes AS (SELECT turn_id, sum(tf) AS dl FROM turn_words GROUP BY 1),
  freq AS (SELECT term, count(*) AS df FROM turn_words GROUP BY 1),
  scored AS (SELECT query_id, turn_id, round(sum(n * greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM query_words JOIN turn_words USING (term) JOIN freq USING (term) JOIN sizes USING (turn_id), totals WHERE turn_id IN (SELECT turn_id FROM turns WHERE {where}) GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, turn_id) AS rank FROM scored)"""


BM25_SQL = bm25_sql()


@query(
    "rk_index_build",
    """WITH every_posting AS (SELECT 'documents' AS corpus, CAST(doc_id AS VARCHAR) AS id, term, tf FROM doc_terms UNION ALL SELECT 'turns', turn_id, term, tf FROM turn_words), l AS (SELECT corpus, id, sum(tf) AS dl FROM every_posting GROUP BY 1, 2), n AS (SELECT corpus, count(*) AS documents FROM l GROUP BY 1)
    SELECT corpus, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(max(tf) AS BIGINT) AS most, CAST(sum(dl) AS BIGINT) AS lengths, any_value(documents) AS documents, count(*) AS postings FROM every_posting JOIN l USING (corpus, id) JOIN n USING (corpus) GROUP BY 1, 2""",
)
def rk_index_build(t: Tables) -> DataFrame:
    """The stored indexes of documents and of turns, written at their first use: what is read back of every term."""
    parts = []
    for corpus in ("documents", "turns"):
        built = t.indexed(corpus)
        n_docs, _ = built.totals()
        per = built.postings.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.max("tf").alias("most"), F.sum("dl").alias("lengths"), F.count("*").alias("postings"))
        parts.append(per.join(built.terms, "term").withColumns({"corpus": F.lit(corpus), "documents": F.lit(n_docs)}))
    return parts[0].unionByName(parts[1])


_STRIPPED = "CASE " + " ".join(f"WHEN suffix(term, '{s}') AND length(term) >= {len(s) + 2} THEN term[:-{len(s) + 1}]" for s in LATIN_SUFFIXES) + " END"


@query(
    "txt_term_freq",
    f"""WITH bases AS (SELECT doc_id, {_STRIPPED} AS term, tf FROM doc_terms)
    SELECT doc_id, term, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT * FROM doc_terms UNION ALL SELECT * FROM bases WHERE term IS NOT NULL) GROUP BY 1, 2""",
)
def txt_term_freq(t: Tables) -> DataFrame:
    return search.term_frequencies_with_bases(t.raw("documents"), "doc_id", "text", LATIN_SUFFIXES)


@query(
    "rk_index_update",
    """WITH now AS (SELECT doc_id, text || CASE WHEN doc_id % 10 = 4 THEN ' appended words words' ELSE '' END AS text FROM documents WHERE doc_id % 10 != 3),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM now) GROUP BY ALL)
    SELECT doc_id, term, tf, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) AS dl, count(*) OVER (PARTITION BY term) AS df FROM p""",
)
def rk_index_update(t: Tables) -> DataFrame:
    """Every tenth document is removed, every tenth changed: the updated index equals a rebuild."""
    docs = t.raw("documents").select("doc_id", "text")
    changed = docs.where("doc_id % 10 = 4").withColumn("text", F.concat("text", F.lit(" appended words words")))
    built = index.build(docs, "doc_id", ["text"], index.shared_folder(t.spark, "index"))
    now = index.update(built, docs.where("doc_id % 10 = 3").select("doc_id"), changed, ["text"])
    return now.counted()


@query(
    "rk_match_search",
    """WITH hits AS (SELECT query_id, doc_id, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS occurrences FROM query_terms JOIN doc_terms USING (term) GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, occurrences DESC, doc_id) AS rank FROM hits""",
)
def rk_match_search(t: Tables) -> DataFrame:
    return search.match_search(t.indexed("documents"), t.query_terms)


@query(
    "rk_match_all",
    """WITH wanted AS (SELECT query_id, count(*) AS wanted FROM query_terms GROUP BY 1),
    hits AS (SELECT query_id, doc_id, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS occurrences FROM query_terms JOIN doc_terms USING (term) GROUP BY 1, 2)
    SELECT query_id, doc_id, matched, occurrences, row_number() OVER (PARTITION BY query_id ORDER BY occurrences DESC, doc_id) AS rank FROM hits JOIN wanted USING (query_id) WHERE matched = wanted""",
)
def rk_match_all(t: Tables) -> DataFrame:
    return search.match_search(t.indexed("documents"), t.query_terms, require_all=True)


@query("rk_bm25", f"WITH {BM25_SQL} SELECT query_id, turn_id, score, rank FROM ranked WHERE rank <= 50")
def rk_bm25(t: Tables) -> DataFrame:
    return search.bm25(t.indexed("turns"), t.query_words, 50)


COSINE_SQL = """
  wanted AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
  scored AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM wanted, embeddings),
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)"""


def _neighbours(t: Tables, k: int) -> DataFrame:
    return vectors.nearest(t.vectors("embeddings"), t.raw("embeddings").where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), k)


@query("rk_vector_topk", f"WITH {COSINE_SQL} SELECT * FROM near WHERE rank <= 10")
def rk_vector_topk(t: Tables) -> DataFrame:
    """Every hundredth vector is a query against all."""
    return _neighbours(t, 10)


@query(
    "rk_semantic",
    f"WITH {COSINE_SQL}, kept AS (SELECT scored.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored JOIN embeddings ON vec_id = id WHERE label % 2 = 0) SELECT * FROM kept WHERE rank <= 5",
)
def rk_semantic(t: Tables) -> DataFrame:
    """The structured filter comes before lists are cut, so k are found wherever k exist."""
    every = t.raw("embeddings")
    return vectors.nearest(t.vectors("embeddings"), every.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 5, within=every.where("label % 2 = 0"))


@query(
    "rk_hash_embedding",
    """WITH hashed AS (SELECT turn_id, ('0x' || sha256(term)[1:8])::BIGINT % 256 AS bucket, CASE WHEN ('0x' || sha256(term)[9:9])::BIGINT % 2 = 0 THEN tf ELSE -tf END AS v FROM turn_terms),
    sums AS (SELECT turn_id, bucket, sum(v)::BIGINT AS v FROM hashed GROUP BY 1, 2 HAVING sum(v) != 0), norms AS (SELECT turn_id, sqrt(sum(v * v)) AS norm FROM sums GROUP BY 1)
    SELECT turn_id, bucket, round(v / norm, 6) AS weight FROM sums JOIN norms USING (turn_id)""",
)
def rk_hash_embedding(t: Tables) -> DataFrame:
    return search.hash_embedding(t.turns, "turn_id", "text")


HASHED = lambda key, text, source: f"""SELECT {key}, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY {key})), 6) AS weight FROM (SELECT {key}, ('0x' || sha256(term)[1:8])::BIGINT % 256 AS bucket, sum(CASE WHEN ('0x' || sha256(term)[9:9])::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS v
    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM {source}) GROUP BY 1, 2 HAVING v != 0)"""  # noqa: E731
def fused_sql(where: str = "TRUE", k: int = 20) -> str:
    """CTEs up to ``final``: ``k`` of either list, from the turns that meet ``where``."""
    return f"""{bm25_sql(where)},
  qv AS ({HASHED('item_id', 'text', 'benchmark')}), tv AS ({HASHED('turn_id', 'text', 'turns')}), qn AS (SELECT item_id, sqrt(sum(weight * weight)) AS n FROM qv GROUP BY 1), tn AS (SELECT turn_id, sqrt(sum(weight * weight)) AS n FROM tv GROUP BY 1),
  dots AS (SELECT q.item_id AS query_id, t.turn_id, sum(q.weight * t.weight) AS dot FROM qv q JOIN tv t USING (bucket) GROUP BY 1, 2),
  near AS (SELECT query_id, tn.turn_id, round(coalesce(dot, 0) / (qn.n * tn.n), 6) AS cosine FROM (SELECT item_id AS query_id, n FROM qn) qn CROSS JOIN tn LEFT JOIN dots USING (query_id, turn_id) WHERE tn.turn_id IN (SELECT turn_id FROM turns WHERE {where})),
  semantic AS (SELECT query_id, turn_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, turn_id) AS rank FROM near),
  lists AS (SELECT query_id, 1 AS list_no, turn_id AS item, rank, 1.0::DOUBLE AS weight FROM ranked WHERE rank <= {k} UNION ALL SELECT query_id, 2, turn_id, rank, 0.5::DOUBLE FROM semantic WHERE rank <= {k}),
  fused AS (SELECT query_id, item, round(sum(weight / (60 + rank)), 9) AS score, min((list_no, rank)) AS first, max(rank) FILTER (WHERE list_no = 1) AS lexical_rank, max(rank) FILTER (WHERE list_no = 2) AS semantic_rank FROM lists GROUP BY 1, 2),
  final AS (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, item) AS rank, lexical_rank, semantic_rank FROM fused)"""


FUSED_SQL = fused_sql()


def query_vectors(t: Tables) -> DataFrame:
    return search.dense(search.hash_embedding(t.raw("benchmark"), "item_id", "text"), "item_id").withColumnRenamed("item_id", "query_id")


def fused(t: Tables, k: int = 20, within: DataFrame | None = None) -> DataFrame:
    """BM25 over five columns and hashed-word vectors, ``k`` of each, the vectors at half the weight."""
    return search.hybrid(t.indexed("turns"), t.query_words, query_vectors(t), t.vectors("turns"), k, (1.0, 0.5), within)


@query("rk_rrf", f"WITH {FUSED_SQL} SELECT * FROM final")
def rk_rrf(t: Tables) -> DataFrame:
    return fused(t)


@query("rk_hybrid", f"WITH {FUSED_SQL} SELECT f.query_id, f.item, f.score, f.rank, lexical_rank, semantic_rank, role, held_on FROM final f JOIN turns ON turn_id = item WHERE f.rank <= 10")
def rk_hybrid(t: Tables) -> DataFrame:
    """Fused ranking with both ranks, hydrated last, for the rows that remain."""
    return fused(t).where("rank <= 10").join(t.turns.select(F.col("turn_id").alias("item"), "role", "held_on"), "item")


BACKEND_SQL = f"""{BM25_SQL}, phrases AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
  own AS (SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS item, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM phrases)"""


@query("ud_candidate_backend", f"WITH {BACKEND_SQL}, l AS (SELECT query_id, 1 AS list_no, turn_id AS item, rank, 1.0::DOUBLE AS weight FROM ranked WHERE rank <= 5 UNION ALL SELECT query_id, 2, item, rank, 2.0::DOUBLE FROM own), f AS (SELECT query_id, item, round(sum(weight / (60 + rank)), 9) AS score, min((list_no, rank)) AS first, max(rank) FILTER (WHERE list_no = 2) AS backend_rank FROM l GROUP BY 1, 2) SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, item) AS rank, backend_rank FROM f")
def ud_candidate_backend(t: Tables) -> DataFrame:
    """A backend of the user's own, here the documents that hold the whole query, joins the keyword list in the fusion."""
    from dossier.operators.linking import substring_links

    hits = substring_links(t.raw("documents").select("doc_id", "text"), t.raw("benchmark").select("item_id", F.col("text").alias("pattern")), "doc_id", "item_id")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id"))
    own = hits.select(F.col("item_id").alias("query_id"), F.lit(2).alias("list_no"), F.col("doc_id").cast("string").alias("item"), place.cast("long").alias("rank"), F.lit(2.0).alias("weight"))
    words = search.bm25(t.indexed("turns"), t.query_words, 5).select("query_id", F.lit(1).alias("list_no"), F.col("turn_id").alias("item"), "rank", F.lit(1.0).alias("weight"))
    return search.reciprocal_rank_fusion(words.unionByName(own), names={2: "backend_rank"})


@query(
    "rk_eval_metrics",
    f"""WITH {COSINE_SQL}, wantedn AS (SELECT a.vec_id AS query_id, count(*) AS wanted FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 GROUP BY 1),
    found AS (SELECT n.query_id, min(rank) AS first, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM near n JOIN embeddings a ON a.vec_id = n.query_id JOIN embeddings b ON b.vec_id = n.id WHERE a.label = b.label AND rank <= 10 GROUP BY 1)
    SELECT query_id, round(coalesce(1 / first, 0), 6) AS rr, round(coalesce(hits / wanted, 0), 6) AS recall,
      round(coalesce(dcg / list_sum(list_transform(generate_series(1, least(wanted, 10)), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM wantedn LEFT JOIN found USING (query_id)""",
)
def rk_eval_metrics(t: Tables) -> DataFrame:
    v = t.raw("embeddings").select("vec_id", "label")
    relevant = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id").join(v.withColumnRenamed("vec_id", "item"), "label").select("query_id", "item")
    return search.retrieval_metrics(_neighbours(t, 10).withColumnRenamed("id", "item"), relevant, 10)


GATE_SQL = """
  q AS (SELECT range AS query_id FROM range(12)),
  scopes AS (SELECT query_id, CASE WHEN query_id = 1 THEN ['0000003', '0000018'] WHEN query_id = 6 THEN ['0000018'] END AS numbers, CASE WHEN query_id IN (2, 7) THEN 'Machine-ry' WHEN query_id = 10 THEN 'the HOUSEHOLD committee' END AS committee,
    CASE WHEN query_id IN (3, 8, 11) THEN DATE '1997-01-01' END AS day_from, CASE WHEN query_id IN (3, 8) THEN DATE '1998-12-31' END AS day_to, query_id IN (3, 11) AS proposal_dated FROM q),
  terms AS (SELECT * FROM (VALUES (0, 'issue', 'urgent'), (0, 'related_issue', 'small'), (1, 'issue', 'low'), (3, 'statute', 'high'), (3, 'related_statute', 'ring'), (5, 'issue', 'widget'), (6, 'issue', 'bolt'), (8, 'related_statute', 'low'), (9, 'issue', 'medium'), (11, 'related_issue', 'gear')) v(query_id, kind, term)),
  proposers AS (SELECT * FROM (VALUES (4, 'representative', 'Customer#000000007'), (4, 'representative', 'Customer#000000011'), (9, 'any', 'Customer#000000007'), (9, 'any', 'Supplier#000000001'), (10, 'co', 'Supplier#000000002'), (10, 'representative', 'Customer#000000007'), (10, 'representative', 'Customer#000000003'))  v(query_id, role, name)),
  keyed AS (SELECT lpad(CAST(group_id AS VARCHAR), 7, '0') AS number, seq, title, proposer FROM agenda),
  offered AS (SELECT DISTINCT number AS candidate, 'representative' AS role, proposer AS name FROM entities UNION SELECT number, 'co', proposer FROM keyed),
  agendas AS (SELECT number, regexp_replace(lower(string_agg(title, ' ' ORDER BY seq)), '[^\\p{L}\\p{N}]', '', 'g') AS agenda FROM keyed GROUP BY 1),
  cand AS (SELECT CASE WHEN term = 16 THEN 'event' ELSE 'entity' END AS kind, number, regexp_replace(lower(committee), '[^\\p{L}\\p{N}]', '', 'g') AS committee, CASE WHEN term != 17 THEN proposed_at END AS proposed_on, processed_at AS day, regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '', 'g') AS title, coalesce(agenda, '') AS agenda,
    regexp_replace(lower(proposer), '[^\\p{L}\\p{N}]', '', 'g') AS body FROM entities LEFT JOIN agendas USING (number)),
  asked AS (SELECT DISTINCT query_id, role AS asked FROM proposers),
  pm AS (SELECT p.query_id, o.candidate, p.role AS asked, p.name, bool_or(o.role = 'representative') AS leads, bool_or(p.role = 'any' OR o.role = p.role) AS fits FROM offered o JOIN proposers p USING (name) GROUP BY 1, 2, 3, 4),
  pr AS (SELECT query_id, candidate, count(*) FILTER (WHERE fits) AS names, string_agg('proposer:' || CASE WHEN asked != 'any' THEN asked WHEN leads THEN 'representative' ELSE 'co' END || ':' || name, ',' ORDER BY 'proposer:' || CASE WHEN asked != 'any' THEN asked WHEN leads THEN 'representative' ELSE 'co' END || ':' || name) FILTER (WHERE fits) AS reasons FROM pm GROUP BY 1, 2),
  missing AS (SELECT r.query_id, c.candidate, min(CASE r.asked WHEN 'representative' THEN 1 WHEN 'co' THEN 2 ELSE 3 END) AS m FROM asked r JOIN pr c USING (query_id) LEFT JOIN pm p ON p.query_id = r.query_id AND p.candidate = c.candidate AND p.asked = r.asked AND p.fits WHERE p.query_id IS NULL GROUP BY 1, 2),
  gated AS (SELECT s.query_id, c.number AS candidate, c.* EXCLUDE (day), CASE WHEN c.kind = 'entity' THEN proposed_on ELSE c.day END AS day, s.numbers IS NOT NULL AS asked, s.committee AS wc, b.query_id IS NOT NULL AND c.kind = 'entity' AS bound, coalesce(pr.names, 0) AS names, pr.reasons AS preasons,
      s.committee IS NOT NULL OR ((day_from IS NOT NULL OR day_to IS NOT NULL) AND (c.kind = 'event' OR proposal_dated)) AS scoped,
      CASE WHEN s.numbers IS NOT NULL AND NOT list_contains(s.numbers, c.number) THEN 'exact_number_mismatch'
        WHEN s.committee IS NOT NULL AND NOT (contains(c.committee, regexp_replace(lower(s.committee), '[^\\p{L}\\p{N}]', '', 'g')) OR contains(regexp_replace(lower(s.committee), '[^\\p{L}\\p{N}]', '', 'g'), c.committee)) THEN 'committee_mismatch'
        WHEN (day_from IS NOT NULL OR day_to IS NOT NULL) AND (c.kind = 'event' OR proposal_dated) AND CASE WHEN c.kind = 'entity' THEN proposed_on ELSE c.day END IS NULL THEN 'missing_date'
        WHEN (day_from IS NOT NULL OR day_to IS NOT NULL) AND (c.kind = 'event' OR proposal_dated) AND NOT (coalesce(CASE WHEN c.kind = 'entity' THEN proposed_on ELSE c.day END >= day_from, true) AND coalesce(CASE WHEN c.kind = 'entity' THEN proposed_on ELSE c.day END <= day_to, true)) THEN 'outside_date_range'
        WHEN b.query_id IS NOT NULL AND c.kind = 'entity' AND (pr.query_id IS NULL OR m.m IS NOT NULL) THEN CASE m.m WHEN 1 THEN 'representative' WHEN 2 THEN 'co' ELSE 'any' END || '_proposer_mismatch' END AS gate
    FROM scopes s CROSS JOIN cand c LEFT JOIN (SELECT DISTINCT query_id FROM proposers) b ON b.query_id = s.query_id LEFT JOIN pr ON pr.query_id = s.query_id AND pr.candidate = c.number LEFT JOIN missing m ON m.query_id = s.query_id AND m.candidate = c.number),
  pts AS (SELECT query_id, number AS candidate, kind, term, CASE WHEN contains(agenda, term) THEN 'agenda' WHEN contains(title, term) THEN 'title' WHEN contains(body, term) THEN 'body' END AS source FROM (SELECT number, title, agenda, body FROM cand), terms),
  valued AS (SELECT *, CASE kind || source WHEN 'statutetitle' THEN 36 WHEN 'statuteagenda' THEN 40 WHEN 'statutebody' THEN 24 WHEN 'issuetitle' THEN 30 WHEN 'issueagenda' THEN 34 WHEN 'issuebody' THEN 22
    WHEN 'related_statutetitle' THEN 12 WHEN 'related_statuteagenda' THEN 14 WHEN 'related_statutebody' THEN 6 WHEN 'related_issuetitle' THEN 11 WHEN 'related_issueagenda' THEN 13 WHEN 'related_issuebody' THEN 5 END AS points FROM pts WHERE source IS NOT NULL),
  topics AS (SELECT query_id, candidate, sum(points) AS topic, string_agg(kind || ':' || term || '@' || source, ',' ORDER BY kind || ':' || term || '@' || source) AS reasons FROM valued GROUP BY 1, 2),
  has AS (SELECT DISTINCT query_id AS q FROM terms),
  joined AS (SELECT g.*, coalesce(topic, 0) AS topic, t.reasons, q IS NOT NULL AS meaningful, coalesce(topic, 0) + CASE WHEN asked THEN 100 ELSE 0 END + CASE WHEN bound THEN 100 * names ELSE 0 END AS raw, q IS NULL AND scoped AND NOT asked AND NOT bound AS structured
    FROM gated g LEFT JOIN topics t USING (query_id, candidate) LEFT JOIN has ON q = g.query_id),
  decided0 AS (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN bound THEN CASE WHEN meaningful AND topic < 10 THEN 'below_minimum_score' END WHEN asked OR structured THEN NULL WHEN NOT meaningful THEN 'no_meaningful_terms' WHEN raw < 10 THEN 'below_minimum_score' END AS rejection FROM joined),
  decided AS (SELECT *, CAST(CASE WHEN gate IS NOT NULL OR rejection = 'no_meaningful_terms' THEN 0 WHEN structured THEN 10 ELSE raw END AS BIGINT) AS score,
    CASE WHEN gate IS NULL THEN concat_ws(',', CASE WHEN asked THEN 'number:' || number END, CASE WHEN bound THEN preasons END, reasons, CASE WHEN structured THEN 'structured_scope_only' END) ELSE '' END AS why FROM decided0)"""

GATE_TERMS = [(0, "issue", "urgent"), (0, "related_issue", "small"), (1, "issue", "low"), (3, "statute", "high"), (3, "related_statute", "ring"), (5, "issue", "widget"), (6, "issue", "bolt"), (8, "related_statute", "low"), (9, "issue", "medium"), (11, "related_issue", "gear")]
GATE_PROPOSERS = [(4, "representative", "Customer#000000007"), (4, "representative", "Customer#000000011"), (9, "any", "Customer#000000007"), (9, "any", "Supplier#000000001"), (10, "co", "Supplier#000000002"), (10, "representative", "Customer#000000007"), (10, "representative", "Customer#000000003")]


def offered_names(t: Tables) -> DataFrame:
    """Who proposes each entity: its customer leads, the suppliers of its agenda rows join."""
    lead = t.entities.select(F.col("number").alias("candidate"), F.lit("representative").alias("role"), F.col("proposer").alias("name"))
    return lead.unionByName(t.agenda.select(F.lpad(F.col("group_id").cast("string"), 7, "0").alias("candidate"), F.lit("co").alias("role"), F.col("proposer").alias("name")))


def gate_decisions(t: Tables) -> DataFrame:
    """Twelve stated queries over all entities; agendas come from line items of the same number."""
    q = F.col("query_id")
    day = lambda test, s: F.when(test, F.lit(s).cast("date"))
    asked = t.spark.range(12).withColumnRenamed("id", "query_id")
    scopes = asked.select(
        "query_id", F.when(q == 1, F.lit(["0000003", "0000018"])).when(q == 6, F.lit(["0000018"])).alias("numbers"), F.when(q.isin(2, 7), "Machine-ry").when(q == 10, "the HOUSEHOLD committee").alias("committee"),
        day(q.isin(3, 8, 11), "1997-01-01").alias("day_from"), day(q.isin(3, 8), "1998-12-31").alias("day_to"), q.isin(3, 11).alias("proposal_dated"),
    )
    terms = t.spark.createDataFrame(GATE_TERMS, "query_id long, kind string, term string")
    proposers = t.spark.createDataFrame(GATE_PROPOSERS, "query_id long, role string, name string")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))), lambda x: x["title"]), " ")
    agendas = t.agenda.groupBy(F.lpad(F.col("group_id").cast("string"), 7, "0").alias("number")).agg(match_key(listed).alias("agenda"))
    own = t.entities.join(agendas, "number", "left").select(
        F.col("number").alias("candidate"), F.when(F.col("term") == 16, "event").otherwise("entity").alias("kind"), "number", "committee", F.when(F.col("term") != 17, F.col("proposed_at")).alias("proposed_on"), F.col("processed_at").alias("day"),
        match_key(F.col("name")).alias("title"), F.coalesce("agenda", F.lit("")).alias("agenda"), match_key(F.col("proposer")).alias("body"),
    )
    each = own.withColumn("query_id", F.explode(F.lit([r.query_id for r in asked.orderBy("query_id").collect()]).cast("array<long>")))  # a dozen stated queries against all rows
    return gate.relevance_gate(each, terms, scopes, offered_names(t), proposers)


@query("rk_relevance_gate", f"WITH {GATE_SQL} SELECT query_id, candidate, number, day, score, rejection IS NULL AS accepted, why AS reasons, rejection FROM decided")
def rk_relevance_gate(t: Tables) -> DataFrame:
    return gate_decisions(t)


@query("rk_gate_rank", f"WITH {GATE_SQL} SELECT query_id, candidate, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, day DESC NULLS LAST, number, candidate) AS rank FROM decided WHERE rejection IS NULL")
def rk_gate_rank(t: Tables) -> DataFrame:
    """Ranks of all accepted candidates; rows of one score and day are ordered in one task, not those of one query."""
    accepted = written(gate_decisions(t).where("accepted").select("query_id", "candidate", "number", "day", "score"), "accepted")  # ranges are sampled first
    return search.ranked_within(accepted, "query_id", gate.order()).select("query_id", "candidate", "score", "rank")


@query("ag_rejections", f"WITH {GATE_SQL} SELECT query_id, rejection, count(*) AS n FROM decided WHERE rejection IS NOT NULL GROUP BY 1, 2")
def ag_rejections(t: Tables) -> DataFrame:
    return gate_decisions(t).where("rejection is not null").groupBy("query_id", "rejection").agg(F.count("*").alias("n"))


@query("rk_gate_decisions", f"WITH {GATE_SQL}, hits AS (SELECT DISTINCT CAST(seq % 12 AS BIGINT) AS query_id, number AS candidate FROM links WHERE link_type = 'EXPLICIT_MENTION'), p AS (SELECT d.*, h.candidate IS NOT NULL AND coalesce(rejection IN ('below_minimum_score', 'no_meaningful_terms'), false) AS promoted FROM decided d LEFT JOIN hits h USING (query_id, candidate)) SELECT query_id, count(*) AS total, CAST(sum((rejection IS NULL OR promoted)::INT) AS BIGINT) AS accepted, CAST(sum(promoted::INT) AS BIGINT) AS promoted, count(*) = count(DISTINCT candidate) AS ids_unique FROM p GROUP BY 1")
def rk_gate_decisions(t: Tables) -> DataFrame:
    """The whole decision table with exact corpus hits promoted: nothing is truncated, ids are unique."""
    hits = t.links.where("link_type = 'EXPLICIT_MENTION'").select((F.col("seq") % 12).alias("query_id"), F.col("number").alias("candidate"))
    n = lambda c: F.count(F.when(F.col(c), 1))
    told = gate.promote(gate_decisions(t), hits).groupBy("query_id").agg(F.count("*").alias("total"), n("accepted").alias("accepted"), n("promoted").alias("promoted"), F.count_distinct("candidate").alias("ids"))
    return told.select("query_id", "total", "accepted", "promoted", (F.col("total") == F.col("ids")).alias("ids_unique"))


@query(
    "rk_importance",
    """WITH linked AS (SELECT number, count(DISTINCT turn_id) AS turns FROM links GROUP BY 1)
    SELECT number, CAST(CASE WHEN result IS NOT NULL THEN 12 WHEN committee != 'BUILDING' THEN 2 ELSE 0 END + least(20, 5 * coalesce(turns, 0)) AS BIGINT) AS score,
      row_number() OVER (PARTITION BY term ORDER BY CASE WHEN result IS NOT NULL THEN 12 WHEN committee != 'BUILDING' THEN 2 ELSE 0 END + least(20, 5 * coalesce(turns, 0)) DESC, coalesce(turns, 0) DESC, proposed_at DESC, number) AS rank, term FROM entities LEFT JOIN linked USING (number)""",
)
def rk_importance(t: Tables) -> DataFrame:
    linked = t.links.groupBy("number").agg(F.countDistinct("turn_id").alias("turns"))
    base = F.when(F.col("result").isNotNull(), 12).when(F.col("committee") != "BUILDING", 2).otherwise(0)
    scored = t.entities.join(linked, "number", "left").withColumn("turns", F.coalesce("turns", F.lit(0))).withColumn("score", (base + F.least(F.lit(20), 5 * F.col("turns"))).cast("long"))
    order = [F.desc("score"), F.desc("turns"), F.desc("proposed_at"), F.asc("number")]
    return search.ranked_within(scored.select("number", "score", "turns", "proposed_at", "term"), "term", order).select("number", "score", "rank", "term")


@query(
    "rk_tier_select",
    f"""WITH {GATE_SQL}, tiered AS (SELECT *, CASE WHEN regexp_matches(why, '(^|,)(statute|issue):[^,]*@(title|agenda)(,|$)') THEN 0 WHEN regexp_matches(why, '(^|,)related_(statute|issue):[^,]*@(title|agenda)(,|$)') THEN 1 WHEN regexp_matches(why, '(^|,)(statute|issue):[^,]*@body(,|$)') THEN 2
      WHEN regexp_matches(why, '(^|,)related_(statute|issue):[^,]*@body(,|$)') THEN 3 WHEN regexp_matches(why, '@(title|agenda)(,|$)') THEN 4 WHEN regexp_matches(why, '@body(,|$)') THEN 5 ELSE 6 END AS tier FROM decided),
    best AS (SELECT query_id, min(tier) FILTER (WHERE rejection IS NULL) AS best FROM tiered GROUP BY 1),
    placed AS (SELECT t.*, row_number() OVER (PARTITION BY t.query_id, rejection IS NULL AND tier = best ORDER BY score DESC, day DESC NULLS LAST, number, candidate) AS place, best FROM tiered t JOIN best USING (query_id))
    SELECT query_id, candidate, CAST(tier AS BIGINT) AS tier, rejection IS NULL AS accepted, rejection IS NULL AND tier = best AS eligible, rejection IS NULL AND tier = best AND place <= 5 AS selected FROM placed""",
)
def rk_tier_select(t: Tables) -> DataFrame:
    """Only the best tier present is eligible; every candidate keeps its flags."""
    return gate.tier_select(gate_decisions(t), 5)


def entity_search_sql(wanted: str, texts: str, k: int) -> str:
    """CTEs up to ``ranked``: ``wanted(query_id, q, w_status, w_term, w_committee)``; ``texts(number, text)`` are the documents' texts."""
    words = lambda text: f"unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'))"
    return f"""wanted AS ({wanted}), raw AS (SELECT DISTINCT query_id, {words('q')} AS term FROM wanted WHERE NOT regexp_matches(q, '^[0-9]+$')),
    asked AS (SELECT query_id, term FROM raw UNION SELECT query_id, {_STRIPPED} FROM raw WHERE {_STRIPPED} IS NOT NULL),
    held AS (SELECT number, term, count(*) AS tf FROM (SELECT number, {words("concat_ws(' ', name, proposer, committee)")} AS term FROM entities) GROUP BY 1, 2), sized AS (SELECT number, sum(tf) AS dl FROM held GROUP BY 1), total AS (SELECT count(*) AS n, avg(dl) AS mean FROM sized), often AS (SELECT term, count(*) AS df FROM held GROUP BY 1),
    named AS (SELECT query_id, number, 1 AS part, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM asked JOIN held USING (term) JOIN often USING (term) JOIN sized USING (number), total GROUP BY 1, 2),
    told AS (SELECT DISTINCT query_id, number, 2 AS part, 0.0 AS score FROM asked JOIN (SELECT DISTINCT number, {words('text')} AS term FROM ({texts})) USING (term)),
    every AS (SELECT query_id, q AS number, 0 AS part, 0.0 AS score FROM wanted WHERE regexp_matches(q, '^[0-9]+$') UNION ALL SELECT * FROM named UNION ALL SELECT * FROM told),
    kept AS (SELECT f.*, proposed_at FROM every f JOIN entities e USING (number) JOIN wanted w USING (query_id) WHERE part = 0 OR (w_status IS NULL OR coalesce(result, 'pending') = w_status) AND (w_term IS NULL OR term = w_term) AND (w_committee IS NULL OR contains(lower(committee), lower(w_committee)))),
    listed AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, proposed_at DESC, number) AS place FROM kept QUALIFY place <= {k}),
    firsts AS (SELECT query_id, number, min((part, place)) AS first FROM listed GROUP BY 1, 2),
    ranked AS (SELECT query_id, number, CAST(first[1] AS BIGINT) AS part, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM firsts QUALIFY rank <= {k})"""


ENTITY_QUERIES = ["Urgent machinery", "customer#00000001 low", "furniture the para der", "household building und"]
_WANTED_SQL = f"SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE WHEN n_nationkey % 5 = 0 THEN lpad(CAST(n_nationkey * 17 + 3 AS VARCHAR), 7, '0') ELSE {ENTITY_QUERIES}[n_nationkey % 5] END AS q, CASE WHEN n_nationkey % 3 = 1 THEN 'pending' END AS w_status, CASE WHEN n_nationkey % 5 = 2 THEN 16 END AS w_term, CASE WHEN n_nationkey % 7 = 3 THEN 'BUILD' END AS w_committee FROM nation"


@query("rk_entity_search", f"WITH {entity_search_sql(_WANTED_SQL, 'SELECT number, text FROM links JOIN turns USING (turn_id) WHERE link_type = $$EXPLICIT_MENTION$$', 30)} SELECT * FROM ranked".replace("$$", "'"))
def rk_entity_search(t: Tables) -> DataFrame:
    """A number is looked up; any word of a query searches name, proposer and committee, and entities whose texts hold one come after; filters come first."""
    k = F.col("n_nationkey")
    word = F.get(F.lit(ENTITY_QUERIES), (k % 5 - 1).cast("int"))
    wanted = t.raw("nation").select(
        k.cast("long").alias("query_id"), F.when(k % 5 == 0, F.lpad((k * 17 + 3).cast("string"), 7, "0")).otherwise(word).alias("q"), F.when(k % 3 == 1, "pending").alias("status"), F.when(k % 5 == 2, 16).alias("term"), F.when(k % 7 == 3, "BUILD").alias("committee"),
    )
    mentions = t.links.where("link_type = 'EXPLICIT_MENTION'").select("turn_id", "number")
    return search.entity_search(t.indexed("entities"), t.indexed("turn_texts"), mentions, t.entities, wanted, 30)


@query(
    "rk_group_relevance",
    """WITH texts AS (SELECT group_id, held_on, lower(string_agg(text || ' ' || committee, ' ' ORDER BY seq)) AS low FROM turns GROUP BY 1, 2),
    topics AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS terms, 'committee ' || CAST(item_id % 7 AS VARCHAR) AS committee FROM benchmark WHERE item_id % 100 = 0),
    scored AS (SELECT query_id, group_id, held_on, len(list_filter(list_distinct(terms), lambda w: contains(low, w))) + CASE WHEN contains(low, committee) THEN 5 ELSE 0 END AS relevance FROM topics, texts)
    SELECT query_id, group_id, held_on, CAST(relevance AS BIGINT) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, held_on DESC, group_id DESC) AS rank FROM scored QUALIFY rank BETWEEN 3 AND 22""",
)
def rk_group_relevance(t: Tables) -> DataFrame:
    """Meetings by the words of every hundredth benchmark text, five more if the query's committee sits in them; places 3 to 22."""
    said = F.array_sort(F.collect_list(F.struct("seq", F.concat("text", F.lit(" "), "committee").alias("said"))))
    texts = t.turns.groupBy("group_id", "held_on").agg(F.array_join(F.transform(said, lambda x: x["said"]), " ").alias("text"))
    topics = t.raw("benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.array_distinct(tokens(F.col("text"))).alias("terms"), F.concat(F.lit("committee "), (F.col("item_id") % 7).cast("string")).alias("committee"))
    return gate.group_relevance(texts, topics, "group_id", "text", "held_on", 2, 20)


COMMITTEES = ["judiciary", "culture", "science", "health"]
COMMITTEE_HINTS = [("health", ["para"]), ("science", ["keit", "schaft"]), ("culture", ["une", "avec"]), ("judiciary", ["the"])]


@query(
    "rk_committee_infer",
    "SELECT doc_id, CASE WHEN contains(l, 'judiciary') THEN 'judiciary' WHEN contains(l, 'culture') THEN 'culture' WHEN contains(l, 'science') THEN 'science' WHEN contains(l, 'health') THEN 'health' WHEN contains(l, 'para') THEN 'health' WHEN contains(l, 'keit') OR contains(l, 'schaft') THEN 'science' WHEN contains(l, 'une') OR contains(l, 'avec') THEN 'culture' WHEN contains(l, 'the') THEN 'judiciary' END AS committee FROM (SELECT doc_id, lower(text || CASE WHEN doc_id % 9 = 4 THEN ' of the Science board' ELSE '' END) AS l FROM documents)",
)
def rk_committee_infer(t: Tables) -> DataFrame:
    asked = F.concat("text", F.when(F.col("doc_id") % 9 == 4, " of the Science board").otherwise(""))
    return t.raw("documents").select("doc_id", gate.infer_committee(asked, COMMITTEES, COMMITTEE_HINTS).alias("committee"))


@query(
    "rk_eval_utility",
    """WITH wanted AS (SELECT group_id, 'committee ' || CAST(group_id % 5 AS VARCHAR) AS expected, group_id % 2 = 0 AS needs_bill FROM meetings), per AS (SELECT group_id, committee, count(*) AS turns, count(*) FILTER (WHERE role = 'assistant') AS answers, avg((trim(text) != '')::INT) AS provenance, avg((regexp_matches(text, '[#*%&]{3}'))::INT) AS noise FROM turns GROUP BY 1, 2), l AS (SELECT group_id, count(*) AS linked FROM links GROUP BY 1),
    parts AS (SELECT group_id, CASE WHEN answers > 0 AND committee = expected THEN 30 WHEN answers > 0 THEN 15 ELSE 0 END AS relevance, least(20, 5 * answers) AS evidence, least(20, 4 * turns) AS context, CAST(round_even(15 * provenance, 0) AS INT) AS sourced, CASE WHEN coalesce(linked, 0) > 0 OR NOT needs_bill THEN 10 ELSE 0 END AS linkage, CASE WHEN noise = 0 THEN 5 ELSE 0 END AS cleanliness FROM per JOIN wanted USING (group_id) LEFT JOIN l USING (group_id))
    SELECT group_id, CAST(relevance + evidence + context + sourced + linkage + cleanliness AS BIGINT) AS score, relevance + evidence + context + sourced + linkage + cleanliness >= 60 AND relevance > 0 AND linkage > 0 AS passed,
      concat_ws(',', CASE WHEN relevance < 30 THEN 'relevance' END, CASE WHEN evidence < 20 THEN 'evidence' END, CASE WHEN context < 20 THEN 'context' END, CASE WHEN sourced < 15 THEN 'provenance' END, CASE WHEN linkage < 10 THEN 'linkage' END, CASE WHEN cleanliness < 5 THEN 'cleanliness' END) AS failures FROM parts""",
)
def rk_eval_utility(t: Tables) -> DataFrame:
    """Every conversation as one case: which committee it should be of, and whether it has to have a linked entity."""
    k = F.col("group_id")
    cases = t.meetings.select("group_id", F.concat(F.lit("committee "), (k % 5).cast("string")).alias("expected"), (k % 2 == 0).alias("needs_bill"))
    per = t.turns.groupBy("group_id", "committee").agg(F.count("*").alias("turns"), F.count(F.when(F.col("role") == "assistant", 1)).alias("answers"), F.avg((F.trim("text") != "").cast("int")).alias("provenance"), F.avg(F.col("text").rlike("[#*%&]{3}").cast("int")).alias("noise"))
    linked = t.links.groupBy("group_id").agg(F.count("*").alias("linked"))
    return search.utility(per.join(cases, "group_id").join(linked, "group_id", "left"), "group_id")


@query(
    "txt_query_terms",
    f"""WITH raw AS (SELECT item_id, list_extract(terms, i) AS term, i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS terms FROM benchmark), unnest(generate_series(1, len(terms))) g(i)),
    pairs AS (SELECT item_id, term, 2 * i AS pos, true AS is_raw FROM raw UNION ALL SELECT item_id, {_STRIPPED} AS base, 2 * i + 1, false FROM raw WHERE base IS NOT NULL),
    seen AS (SELECT *, count(*) OVER (PARTITION BY item_id, term ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pairs)
    SELECT item_id, string_agg(term, ' ' ORDER BY pos) AS terms FROM seen WHERE is_raw OR before = 0 GROUP BY 1""",
)
def txt_query_terms(t: Tables) -> DataFrame:
    from dossier.functions.text import query_terms

    return t.raw("benchmark").select("item_id", F.array_join(query_terms(F.col("text")), " ").alias("terms"))




def _letter_counts():
    """A stand-in for a model: relative frequencies of five letters."""
    import numpy as np

    def embed(texts):
        counts = np.array([[t.count(c) for c in "aeiou"] for t in texts], np.float32).reshape(-1, 5)
        return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)

    return embed


LETTERS_SQL = "l AS (SELECT turn_id, text, [len(text) - len(replace(text, c, '')) FOR c IN ['a', 'e', 'i', 'o', 'u']] AS n FROM turns)"


@query("ud_embedder", f"WITH {LETTERS_SQL} SELECT turn_id, CAST(generate_subscripts(n, 1) - 1 AS BIGINT) AS dimension, round(CAST(unnest(n) AS DOUBLE) / greatest(list_sum(n), 1), 4) AS value FROM l")
def ud_embedder(t: Tables) -> DataFrame:
    from dossier.functions.embedding import embed

    made = t.turns.select("turn_id", F.posexplode(embed(F.col("text"), _letter_counts, 5)).alias("dimension", "value"))
    return made.select("turn_id", F.col("dimension").cast("long").alias("dimension"), F.round(F.col("value").cast("double"), 4).alias("value"))


@query("rk_embed_build", "SELECT turn_id, CASE WHEN seq % 7 = 3 THEN 'missing' WHEN seq % 7 = 5 THEN 'stale' END AS fault FROM turns WHERE seq % 7 IN (3, 5)")
def rk_embed_build(t: Tables) -> DataFrame:
    """Vectors built from an older text are found by its hash, as are rows without one."""
    from dossier.functions.embedding import build_vectors, stale_vectors

    older = t.turns.where("seq % 7 != 3").withColumn("text", F.when(F.col("seq") % 7 == 5, F.concat("text", F.lit(" older"))).otherwise(F.col("text")))
    return stale_vectors(build_vectors(older, "turn_id", "text", _letter_counts, 5, "letters"), t.turns, "turn_id", "text")


def speech_sql(where: str = "TRUE") -> str:
    return f"""{fused_sql(where)}, m AS (SELECT query_id, turn_id AS item, string_agg(DISTINCT term, ' ' ORDER BY term) AS matched_terms FROM query_words JOIN turn_words USING (term) GROUP BY 1, 2),
  a AS (SELECT turn_id AS item, group_id, lag(turn_id) OVER w AS previous, lead(turn_id) OVER w AS next FROM turns WINDOW w AS (PARTITION BY group_id ORDER BY seq))"""


SPEECH_SQL = speech_sql()


def shown(t: Tables, best: DataFrame) -> DataFrame:
    """``best(query_id, item, ...)`` with matched terms, neighbours and citation."""
    from dossier.operators.linking import adjacent

    best = written(best, "shown")  # the search runs once; what is left is k rows of each query
    held = best.select("query_id", "item").join(t.indexed("turns").documents.select(F.col("turn_id").alias("item"), "terms"), "item")
    words = held.select("query_id", "item", F.explode("terms").alias("term")).join(t.query_words.select("query_id", "term"), ["query_id", "term"])
    matched = words.groupBy("query_id", "item").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("matched_terms"))  # a query's own terms
    around = adjacent(t.turns.select("group_id", "seq", "turn_id", "text")).select(F.col("turn_id").alias("item"), "group_id", "previous", "next")
    return best.join(matched, ["query_id", "item"], "left").join(around, "item").join(t.meetings.select("group_id", "url"), "group_id").drop("group_id")


@query("rk_speech_search", f"WITH {SPEECH_SQL} SELECT f.query_id, f.item, f.rank, f.score, lexical_rank, semantic_rank, 'hybrid' AS mode, matched_terms, previous, next, url FROM final f LEFT JOIN m USING (query_id, item) JOIN a USING (item) JOIN meetings USING (group_id) WHERE f.rank <= 5 UNION ALL SELECT r.query_id, r.turn_id, r.rank, round(1 / (60 + r.rank), 9), r.rank, NULL, 'lexical', matched_terms, previous, next, url FROM ranked r JOIN m ON m.query_id = r.query_id AND m.item = r.turn_id JOIN a ON a.item = r.turn_id JOIN meetings USING (group_id) WHERE r.rank <= 5")
def rk_speech_search(t: Tables) -> DataFrame:
    """The end user's search in both modes: hybrid, and lexical alone with the scores that ranks give by default."""
    hybrid = fused(t).where("rank <= 5").withColumn("mode", F.lit("hybrid"))
    lexical = search.bm25(t.indexed("turns"), t.query_words, 5).select("query_id", F.col("turn_id").alias("item"), F.round(1 / (60 + F.col("rank")), 9).alias("score"), "rank", F.col("rank").alias("lexical_rank"), F.lit(None).cast("long").alias("semantic_rank"), F.lit("lexical").alias("mode"))
    best = written(hybrid.unionByName(lexical), "best-turns")
    found = shown(t, best.select("query_id", "item").distinct())
    return best.join(found, ["query_id", "item"])
