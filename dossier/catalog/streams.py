"""Streaming queries: what has arrived is processed, and the final table is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import scratch
from dossier.registry import query
from dossier.streaming import arrivals
from dossier.views import Tables


def events(t: Tables) -> DataFrame:
    return arrivals.open_stream(t.spark, f"{t.sf_dir}/events.parquet")


OUTCOMES_SQL = """o AS (SELECT event_id // 3 AS work_id, event_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'retryable' END AS status, CAST(floor(value) AS BIGINT) AS content FROM events),
  f AS (SELECT work_id, min_by((event_id, status, content), event_id) FILTER (WHERE status != 'retryable') AS t, max_by((event_id, status, content), event_id) AS l FROM o GROUP BY 1), k AS (SELECT work_id, coalesce(t, l) AS kept, t IS NOT NULL AS stays FROM f)"""


@query("st_idempotent_ingest", f"WITH {OUTCOMES_SQL} SELECT o.work_id, any_value(kept[1]) AS event_id, any_value(kept[2]) AS status, any_value(kept[3]) AS content, count(*) FILTER (WHERE stays AND event_id > kept[1] AND NOT (status = kept[2] AND content = kept[3])) AS conflicts FROM o JOIN k ON k.work_id = o.work_id GROUP BY 1")
def st_idempotent_ingest(t: Tables) -> DataFrame:
    """Every outcome is delivered twice and counted once; retryable ones may be replaced, terminal ones may not."""
    twice = events(t).unionByName(events(t))
    once = arrivals.absorb_redelivery(twice, "event_id", "ts")
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").otherwise("retryable")
    outcomes = once.select(F.floor(F.col("event_id") / 3).cast("long").alias("work_id"), "event_id", status.alias("status"), F.floor("value").cast("long").alias("content"))
    return arrivals.absorb_outcomes(outcomes, "work_id", "event_id", "status", "content", ["success", "failed"])


@query("st_readiness", "SELECT user_id, expected FROM (SELECT user_id, count(DISTINCT event_type || CAST(event_id % 3 AS VARCHAR)) AS seen, 8 + user_id % 9 AS expected FROM events GROUP BY 1) WHERE seen >= expected")
def st_readiness(t: Tables) -> DataFrame:
    """Keys whose pieces have all come, each once, in the batch in which it became ready."""
    pieces = events(t).withColumns({"piece": F.concat("event_type", (F.col("event_id") % 3).cast("string")), "total": F.col("user_id") % 9 + 8})
    return arrivals.drain_keyed(arrivals.readiness(pieces, "user_id", "piece", "total")).select("user_id", "expected")


@query("st_progress", "WITH c AS (SELECT user_id, count(*) AS arrived, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(*) FILTER (WHERE event_type = 'error') AS failed, 5 + user_id % 40 AS expected FROM events GROUP BY 1) SELECT *, greatest(expected - accepted - failed, 0) AS pending, accepted + failed >= expected AS complete FROM c")
def st_progress(t: Tables) -> DataFrame:
    counted = arrivals.progress(events(t).withColumn("total", F.col("user_id") % 40 + 5), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", "total")
    return arrivals.latest_state(arrivals.drain(counted, "update"), ["user_id"])


@query(
    "st_threads",
    """WITH g AS (SELECT user_id, ts, coalesce(CAST(ts - lag(ts) OVER w >= INTERVAL 6 HOUR AS INT), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
    s AS (SELECT user_id, k, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM n GROUP BY 1, 2) SELECT user_id, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at, n FROM s WHERE last_at + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
)
def st_threads(t: Tables) -> DataFrame:
    """Sessions that the watermark has passed."""
    closed = arrivals.drain(arrivals.threads(events(t), "user_id", "ts", "6 hours"), "append")
    return closed.select("user_id", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), "n")


@query("st_incremental_index", "WITH a AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 2 THEN ' corrected text' ELSE '' END AS text FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM a) GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM p GROUP BY 1")
def st_incremental_index(t: Tables) -> DataFrame:
    """The index maintained as documents arrive, of which every fifth comes again with a correction, equals one built of the last texts."""
    docs = t.raw("documents").select("doc_id", "text", F.lit(1).alias("wave"))
    again = docs.where("doc_id % 5 = 2").select("doc_id", F.concat("text", F.lit(" corrected text")).alias("text"), F.lit(2).alias("wave"))
    folder, files = scratch.shared_folder(t.spark, "arriving"), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    for wave in (docs, again):
        wave.repartition(files, "doc_id").write.mode("append").parquet(f"{folder}/documents")
    stream = arrivals.open_stream(t.spark, f"{folder}/documents", files_per_trigger=files)
    held = arrivals.incremental_index(stream, "doc_id", ["text"], "wave")
    return held.postings.groupBy("term").agg(F.sum("tf").alias("occurrences")).join(held.terms, "term")
