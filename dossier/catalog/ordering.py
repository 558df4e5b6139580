"""Window and ordering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators import corpus, paging
from dossier.operators.search import ranked_within
from dossier.registry import query
from dossier.scratch import shared_folder
from dossier.views import Tables

TIMELINE_SQL = """
  timeline AS (SELECT number, proposed_at AS day, 'proposed' AS event_type, number AS ref FROM entities UNION ALL SELECT number, processed_at, 'processed', number FROM entities WHERE processed_at IS NOT NULL
    UNION ALL SELECT number, held_on, 'debate', turn_id FROM links)"""


def timeline(t: Tables) -> DataFrame:
    pick = lambda df, day, kind, ref: df.select("number", F.col(day).alias("day"), F.lit(kind).alias("event_type"), F.col(ref).alias("ref"))
    return pick(t.entities, "proposed_at", "proposed", "number").unionByName(pick(t.entities.where("processed_at is not null"), "processed_at", "processed", "number")).unionByName(pick(t.links, "held_on", "debate", "turn_id"))


@query("wn_timeline", f"WITH {TIMELINE_SQL} SELECT *, row_number() OVER (PARTITION BY number ORDER BY day, event_type, ref) AS place FROM timeline")
def wn_timeline(t: Tables) -> DataFrame:
    order = Window.partitionBy("number").orderBy("day", "event_type", "ref")
    return timeline(t).withColumn("place", F.row_number().over(order).cast("long"))


CORE_SQL = f"""{TIMELINE_SQL},
  axes AS (SELECT *, CASE event_type WHEN 'proposed' THEN 1 WHEN 'processed' THEN 2 ELSE 3 END AS priority FROM timeline),
  firsts AS (SELECT *, CASE WHEN event_type = 'processed' THEN row_number() OVER (PARTITION BY number, event_type ORDER BY day DESC, ref) ELSE row_number() OVER (PARTITION BY number, event_type ORDER BY day, ref) END AS k FROM axes),
  chosen AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, priority, day, ref) AS place FROM firsts)"""


@query("wn_core", f"WITH {CORE_SQL} SELECT number, event_type, ref, place, CASE WHEN k = 1 THEN 'representative' ELSE 'fill' END AS reason FROM chosen WHERE place <= 6")
def wn_core(t: Tables) -> DataFrame:
    """One representative an axis (the latest of a status, else the earliest), then filled up to six."""
    own = timeline(t).withColumn("priority", F.when(F.col("event_type") == "proposed", 1).when(F.col("event_type") == "processed", 2).otherwise(3))
    axis = Window.partitionBy("number", "event_type")
    k = F.when(F.col("event_type") == "processed", F.row_number().over(axis.orderBy(F.desc("day"), "ref"))).otherwise(F.row_number().over(axis.orderBy("day", "ref")))
    first = own.withColumn("fill", (k != 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("number").orderBy("fill", "priority", "day", "ref")).cast("long")
    return first.withColumn("place", place).where("place <= 6").select("number", "event_type", "ref", "place", F.when(F.col("fill") == 0, "representative").otherwise("fill").alias("reason"))


@query("wn_group_primary", "SELECT source, min_by(doc_id, (CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, n_chars, doc_id)) AS doc_id, count(*) AS members FROM documents GROUP BY 1")
def wn_group_primary(t: Tables) -> DataFrame:
    priority = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    return t.raw("documents").groupBy("source").agg(F.min_by("doc_id", F.struct(priority, "n_chars", "doc_id")).alias("doc_id"), F.count("*").alias("members"))


@query("wn_latest_per_key", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def wn_latest_per_key(t: Tables) -> DataFrame:
    return corpus.latest(t.raw("events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("wn_list_meetings", "SELECT committee, group_id, held_on, row_number() OVER (PARTITION BY committee ORDER BY held_on DESC, group_id) AS place FROM meetings WHERE kind != 'plenary'")
def wn_list_meetings(t: Tables) -> DataFrame:
    rows = t.meetings.where("kind != 'plenary'").select("committee", "group_id", "held_on")
    return ranked_within(rows, "committee", [F.desc("held_on"), F.asc("group_id")]).withColumnRenamed("rank", "place")


@query("wn_source_cards", "WITH c AS (SELECT number, url, seq, left(text, 80) AS shown, turn_id FROM links JOIN turns USING (turn_id, group_id, seq) JOIN meetings USING (group_id)), r AS (SELECT *, row_number() OVER (PARTITION BY number, url ORDER BY seq, turn_id) AS k FROM c) SELECT number, url, shown FROM r WHERE k = 1")
def wn_source_cards(t: Tables) -> DataFrame:
    """A card for each (query, url), its first appearance; only that card's text is carried on."""
    first = t.links.join(t.meetings.select("group_id", "url"), "group_id").groupBy("number", "url").agg(F.min_by("turn_id", F.struct("seq", "turn_id")).alias("turn_id"))
    return first.join(t.turns.select("turn_id", F.left("text", F.lit(80)).alias("shown")), "turn_id").select("number", "url", "shown")


@query(
    "wn_keyset_page",
    """WITH r AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place, count(*) OVER (PARTITION BY lang) AS total FROM documents), after AS (SELECT lang, n_chars AS c, doc_id AS d FROM r WHERE place = 20)
    SELECT r.lang, doc_id, place, total, greatest(total - 30, 0) AS remaining FROM r JOIN after USING (lang) WHERE (n_chars < c OR (n_chars = c AND doc_id > d)) AND place <= 30""",
)
def wn_keyset_page(t: Tables) -> DataFrame:
    """The third page of ten of each language, from the files that hold it."""
    docs = t.raw("documents").select("lang", "doc_id", "n_chars")
    held = paging.store(docs, "lang", ["-n_chars", "doc_id"], shared_folder(t.spark, "pages"))
    return held.read(dict.fromkeys(held.axes(), 20), 10).select("lang", "doc_id", "place", "total", "remaining")


@query("so_union_first", "WITH u AS (SELECT lang, doc_id, 1 AS part, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k FROM documents UNION ALL SELECT lang, doc_id, 2, row_number() OVER (PARTITION BY lang ORDER BY doc_id) FROM documents), f AS (SELECT lang, doc_id, min((part, k)) AS first FROM u WHERE k <= 15 GROUP BY 1, 2) SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY first) AS place FROM f")
def so_union_first(t: Tables) -> DataFrame:
    docs = t.raw("documents").select("lang", "doc_id", "n_chars")
    by = lambda *cols: F.row_number().over(Window.partitionBy("lang").orderBy(*cols))
    listed = lambda n, *cols: docs.withColumn("k", by(*cols)).where("k <= 15").select("lang", "doc_id", F.struct(F.lit(n).alias("part"), "k").alias("at"))
    firsts = listed(1, "n_chars", "doc_id").unionByName(listed(2, "doc_id")).groupBy("lang", "doc_id").agg(F.min("at").alias("first"))
    return firsts.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("first")).cast("long").alias("place"))


@query("so_unique_last", "SELECT user_id, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def so_unique_last(t: Tables) -> DataFrame:
    return t.raw("events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))
