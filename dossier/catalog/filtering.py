"""Filter and scope queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from dossier.operators import search
from dossier.operators.filters import collapse_months, content_terms, derived_months, matching, proposal_scope, strict_family, structured
from dossier.operators.linking import interval_scope, intersecting_scopes
from dossier.registry import query
from dossier.views import Tables


@query("flt_structured", "SELECT turn_id FROM turns WHERE term = 19 AND role = 'user' AND organization = 'office 1' AND kind = 'committee' AND contains(lower(committee), 'ittee') AND contains(lower(speaker), 'user') AND held_on BETWEEN DATE '2020-01-01' AND DATE '2022-12-31'")
def flt_structured(t: Tables) -> DataFrame:
    wanted = {"term": 19, "role": "user", "organization": "office 1", "kind": "committee", "committee": "ITTEE", "speaker": "User", "day_from": "2020-01-01", "day_to": "2022-12-31"}
    return structured(t.turns, **wanted).select("turn_id")


FILTER_SQL = """wanted AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 4 + 18 END AS w_term, CASE WHEN n_nationkey % 2 = 0 THEN 'user' END AS w_role, CASE WHEN n_nationkey % 4 = 1 THEN 'office 1' END AS w_organization,
    CASE WHEN n_nationkey % 7 = 2 THEN 'plenary' END AS w_kind, CASE WHEN n_nationkey % 5 = 1 THEN 'EE 3' END AS w_committee, CASE WHEN n_nationkey % 6 = 1 THEN 'T 2' END AS w_speaker, CASE WHEN n_nationkey % 5 = 0 THEN DATE '2020-03-01' END AS w_from, CASE WHEN n_nationkey % 10 = 0 THEN DATE '2021-03-01' END AS w_to FROM nation)"""
FILTER_ON = """(w_term IS NULL OR term = w_term) AND (w_role IS NULL OR role = w_role) AND (w_organization IS NULL OR organization = w_organization) AND (w_kind IS NULL OR kind = w_kind) AND (w_committee IS NULL OR contains(lower(committee), lower(w_committee)))
    AND (w_speaker IS NULL OR contains(lower(speaker), lower(w_speaker))) AND (w_from IS NULL OR held_on >= w_from) AND (w_to IS NULL OR held_on <= w_to)"""


def query_filters(t: Tables) -> DataFrame:
    """Eight filters of each query, null where it sets none."""
    k = F.col("n_nationkey")
    day = lambda test, s: F.when(test, F.lit(s).cast("date"))
    return t.raw("nation").select(
        k.cast("long").alias("query_id"), F.when(k % 3 == 0, k % 4 + 18).alias("term"), F.when(k % 2 == 0, "user").alias("role"), F.when(k % 4 == 1, "office 1").alias("organization"), F.when(k % 7 == 2, "plenary").alias("kind"),
        F.when(k % 5 == 1, "EE 3").alias("committee"), F.when(k % 6 == 1, "T 2").alias("speaker"), day(k % 5 == 0, "2020-03-01").alias("day_from"), day(k % 10 == 0, "2021-03-01").alias("day_to"),
    )


@query("flt_query_filters_join", f"WITH {FILTER_SQL} SELECT query_id, turn_id FROM wanted JOIN turns ON {FILTER_ON}")
def flt_query_filters_join(t: Tables) -> DataFrame:
    return matching(t.turns, query_filters(t))


TERMS = [(15, "1995-03-01", "1996-12-31"), (16, "1997-01-01", "1998-06-30"), (17, "1998-09-01", "2000-12-31")]
TERMS_SQL = "terms AS (SELECT * FROM (VALUES (15::BIGINT, DATE '1995-03-01', DATE '1996-12-31'), (16, DATE '1997-01-01', DATE '1998-06-30'), (17, DATE '1998-09-01', DATE '2000-12-31')) v(scope, day_from, day_to))"


def office_terms(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(TERMS, "scope long, f string, u string").select("scope", F.col("f").cast("date").alias("day_from"), F.col("u").cast("date").alias("day_to"))


@query("flt_interval_scope", f"WITH {TERMS_SQL} SELECT number, proposed_at, t.scope, (SELECT coalesce(string_agg(CAST(scope AS VARCHAR), ',' ORDER BY scope), '') FROM terms m WHERE m.day_from <= coalesce(processed_at, DATE '9999-12-31') AND m.day_to >= proposed_at) AS scopes FROM entities LEFT JOIN terms t ON proposed_at BETWEEN t.day_from AND t.day_to")
def flt_interval_scope(t: Tables) -> DataFrame:
    """The term of each proposal, null in the gaps, and all terms that the time up to its processing meets."""
    own = interval_scope(t.entities.select("number", "proposed_at", "processed_at"), office_terms(t), "proposed_at")
    return intersecting_scopes(own, office_terms(t), "proposed_at", "processed_at").select("number", "proposed_at", "scope", F.array_join(F.transform("scopes", lambda s: s.cast("string")), ",").alias("scopes"))


MONTH_SQL = """spans AS (SELECT number, proposed_at AS f, processed_at AS u FROM entities WHERE processed_at IS NOT NULL),
  months AS (SELECT number, f, u, CAST(unnest(generate_series(CAST(date_trunc('month', f) AS TIMESTAMP), CAST(u AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM spans)"""


def month_slices(spans: DataFrame) -> DataFrame:
    """``(number, f, u)`` cut into calendar months that tile it."""
    months = spans.withColumn("m", F.explode(F.sequence(F.trunc("f", "MM"), F.col("u"), F.expr("interval 1 month"))))
    return months.select("number", F.greatest("m", "f").alias("slice_from"), F.least(F.last_day("m"), "u").alias("slice_to"))


@query("flt_month_buckets", f"WITH {MONTH_SQL} SELECT number, greatest(m, f) AS slice_from, least(last_day(m), u) AS slice_to FROM months")
def flt_month_buckets(t: Tables) -> DataFrame:
    return month_slices(t.entities.where("processed_at is not null").select("number", F.col("proposed_at").alias("f"), F.col("processed_at").alias("u")))


@query("flt_month_tiling", f"WITH {MONTH_SQL}, s AS (SELECT number, greatest(m, f) AS a, least(last_day(m), u) AS b FROM months), g AS (SELECT number, a, lag(b) OVER (PARTITION BY number ORDER BY a) AS before FROM s) SELECT number, CAST(count(*) FILTER (WHERE before IS NOT NULL AND a != before + 1) AS BIGINT) AS faults, count(*) AS slices FROM g GROUP BY 1")
def flt_month_tiling(t: Tables) -> DataFrame:
    slices = flt_month_buckets(t)
    before = F.lag("slice_to").over(Window.partitionBy("number").orderBy("slice_from"))
    fault = F.count(F.when(F.col("before").isNotNull() & (F.col("slice_from") != F.date_add("before", 1)), 1))
    return slices.withColumn("before", before).groupBy("number").agg(fault.alias("faults"), F.count("*").alias("slices"))


@query(
    "flt_collapse_months",
    "WITH m AS (SELECT DISTINCT committee, year(proposed_at) AS y, month(proposed_at) AS mo FROM entities WHERE proposed_at <= DATE '2000-09-14' AND NOT (committee = 'BUILDING' AND month(proposed_at) = 4)), c AS (SELECT committee, y, count(*) AS n FROM m GROUP BY 1, 2) SELECT committee, CAST(y AS BIGINT) AS y, CASE WHEN n = CASE WHEN y = 2000 THEN 9 ELSE 12 END THEN CAST(y AS VARCHAR) ELSE CAST(y AS VARCHAR) || '-' || lpad(CAST(mo AS VARCHAR), 2, '0') END AS key FROM c JOIN m USING (committee, y) GROUP BY ALL",
)
def flt_collapse_months(t: Tables) -> DataFrame:
    """A year with all its months becomes one key, and so does the current one with all that have passed."""
    own = t.entities.where("proposed_at <= date'2000-09-14' and not (committee = 'BUILDING' and month(proposed_at) = 4)")
    return collapse_months(own.select("committee", F.year("proposed_at").cast("long").alias("y"), F.month("proposed_at").alias("mo")), ["committee"], "2000-09-14")


DROP_SQL = """causes AS (SELECT 'event' AS family, number, CASE WHEN term = 17 AND committee = 'BUILDING' THEN 'missing_date' WHEN proposed_at < DATE '1996-01-01' OR proposed_at > DATE '1999-12-31' THEN 'outside_range' WHEN committee = 'HOUSEHOLD' THEN 'missing_committee' WHEN committee != 'MACHINERY' THEN 'committee_mismatch' END AS cause FROM entities
  UNION ALL SELECT 'bill', number, CASE WHEN committee = 'HOUSEHOLD' THEN 'missing_committee' WHEN committee != 'MACHINERY' THEN 'committee_mismatch' END FROM entities)"""


@query("flt_strict_family", f"WITH {DROP_SQL} SELECT family, coalesce(cause, 'kept') AS cause, count(*) AS n FROM causes GROUP BY 1, 2")
def flt_strict_family(t: Tables) -> DataFrame:
    """Causes of both families: events have dates, for bills they do not count."""
    day = F.when(~((F.col("term") == 17) & (F.col("committee") == "BUILDING")), F.col("proposed_at"))
    committee = F.when(F.col("committee") != "HOUSEHOLD", F.col("committee"))
    family = lambda name, d: strict_family(t.entities, d, committee, "1996-01-01", "1999-12-31", "machinery").select(F.lit(name).alias("family"), "cause")
    return family("event", day).unionByName(family("bill", None)).groupBy("family", F.coalesce("cause", F.lit("kept")).alias("cause")).agg(F.count("*").alias("n"))


@query("flt_status", "SELECT number, coalesce(result, 'pending') AS status, result IS NULL AS is_pending FROM entities")
def flt_status(t: Tables) -> DataFrame:
    blank = F.coalesce(F.trim("result"), F.lit("")) == ""
    return t.entities.select("number", F.when(blank, "pending").otherwise(F.col("result")).alias("status"), blank.alias("is_pending"))


@query("flt_proposal_scope", "WITH e AS (SELECT number FROM entities WHERE term != 17 AND proposed_at BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'), l AS (SELECT * FROM links WHERE number IN (SELECT number FROM e)) SELECT 'entities' AS part, count(*) AS n FROM e UNION ALL SELECT 'inventory', count(*) FROM agenda WHERE number IN (SELECT number FROM e) UNION ALL SELECT 'links', count(*) FROM l UNION ALL SELECT 'threads', count(DISTINCT group_id) FROM turns WHERE turn_id IN (SELECT turn_id FROM l)")
def flt_proposal_scope(t: Tables) -> DataFrame:
    """Entities proposed in three years, undated ones (term 17) left out, and what of inventories, links and threads they reach."""
    dated = t.entities.withColumn("proposed_at", F.when(F.col("term") != 17, F.col("proposed_at")))
    kept = proposal_scope(dated, t.agenda.select("number"), t.links, t.turns.select("turn_id", F.col("group_id").alias("thread")), "1996-01-01", "1998-12-31")
    kept["threads"] = kept["threads"].select("thread").distinct()
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "flt_content_terms",
    "WITH n AS (SELECT query_id, count(*) AS wanted FROM query_terms GROUP BY 1), h AS (SELECT query_id, turn_id, count(*) AS matched FROM query_terms JOIN turn_terms USING (term) GROUP BY 1, 2), f AS (SELECT h.*, matched >= least(2, wanted) AS good FROM h JOIN n USING (query_id)), g AS (SELECT *, bool_or(good) OVER (PARTITION BY query_id) AS any_good FROM f) SELECT query_id, turn_id, matched FROM g WHERE good OR NOT any_good",
)
def flt_content_terms(t: Tables) -> DataFrame:
    """Results with two of the query's terms; where none has, all stay."""
    hits = search.match_hits(t.indexed("turn_texts"), t.query_terms).drop("occurrences")
    return content_terms(hits, t.query_terms.groupBy("query_id").agg(F.count("*").alias("wanted")))


@query("flt_derived_window", f"""WITH {TERMS_SQL}, q AS (SELECT n_nationkey AS query_id, [15, 16, 17, 99][n_nationkey % 4 + 1] AS scope, n_nationkey % 3 = 0 AS history FROM nation), u AS (SELECT query_id, history, least(DATE '2000-10-20', coalesce(day_to, DATE '2000-10-20')) AS upto FROM q LEFT JOIN terms USING (scope)),
  m AS (SELECT CAST(number AS BIGINT) % 25 AS query_id, proposed_at, processed_at FROM entities), d AS (SELECT query_id, upto, unnest([proposed_at, processed_at]) AS day FROM m JOIN u USING (query_id)), f AS (SELECT query_id, min(proposed_at) AS first FROM m GROUP BY 1)
  SELECT CAST(query_id AS BIGINT) AS query_id, CAST(date_trunc('month', day) AS DATE) AS month FROM d WHERE day <= upto UNION SELECT query_id, CAST(unnest([date_trunc('month', upto), date_trunc('month', upto - INTERVAL 1 MONTH)]) AS DATE) FROM u
  UNION SELECT query_id, CAST(unnest(generate_series(CAST(date_trunc('month', first) AS TIMESTAMP), CAST(date_trunc('month', upto) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) FROM f JOIN u USING (query_id) WHERE history AND first <= upto""")
def flt_derived_window(t: Tables) -> DataFrame:
    """Months of each query's matched entities and its last two; a third of the queries ask for the whole history."""
    k = F.col("n_nationkey")
    queries = t.raw("nation").select(k.cast("long").alias("query_id"), F.get(F.lit([15, 16, 17, 99]), (k % 4).cast("int")).cast("long").alias("scope"), (k % 3 == 0).alias("history"))
    matched = t.entities.select((F.col("number").cast("long") % 25).alias("query_id"), "proposed_at", "processed_at")
    return derived_months(matched, queries, "2000-10-20", office_terms(t).select("scope", "day_to"))


@query("flt_meeting_window", "SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE event_id % 13 != 5 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def flt_meeting_window(t: Tables) -> DataFrame:
    """Raw date texts in several forms; what does not parse is dropped."""
    from dossier.functions.text import parse_any_date

    form = F.when(F.col("event_id") % 13 == 5, F.lit("n/a")).when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy.MM.dd")).otherwise(F.date_format("ts", "yyyyMMdd"))
    raw = t.raw("events").select("event_id", form.alias("raw"))
    return raw.select("event_id", parse_any_date(F.col("raw")).alias("day")).where("day between date'2024-01-05' and date'2024-01-12'")


@query("txt_script_flag", "SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS latin_only, regexp_matches(text, '[äöüß]') AS german FROM documents")
def txt_script_flag(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", (~F.col("text").rlike(r"[^\x00-\x7F]")).alias("latin_only"), F.col("text").rlike("[äöüß]").alias("german"))


@query("txt_question_flag", "SELECT turn_id, contains(text, 'que ') OR contains(text, 'the') AS asks FROM turns")
def txt_question_flag(t: Tables) -> DataFrame:
    from dossier.functions.text import contains_any

    return t.turns.select("turn_id", contains_any(F.col("text"), ["que ", "the"]).alias("asks"))


