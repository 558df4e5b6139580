"""Streams that keep state by key: restarts, late rows, timeouts."""

from __future__ import annotations

import time

from dossier import scratch
from dossier.streaming import arrivals


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def put(spark, folder, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


OUTCOMES = "work long, at long, status string, content long"


def test_outcomes_go_on_after_a_restart(spark):
    folder = scratch.shared_folder(spark, "outcomes")
    run = lambda: arrivals.absorb_outcomes(arrivals.open_stream(spark, f"{folder}/in"), "work", "at", "status", "content", ["done", "failed"], f"{folder}/checkpoint", f"{folder}/out")
    put(spark, f"{folder}/in", [(1, 1, "retry", 0), (2, 1, "retry", 0), (2, 2, "done", 5), (2, 3, "done", 5), (2, 4, "done", 6), (3, 1, "failed", 0), (4, 9, "retry", 1), (4, 3, "retry", 2)], OUTCOMES)
    assert rows(run(), "work", "at", "status", "content", "conflicts") == [(1, 1, "retry", 0, 0), (2, 2, "done", 5, 1), (3, 1, "failed", 0, 0), (4, 9, "retry", 1, 0)]
    put(spark, f"{folder}/in", [(1, 0, "done", 7), (2, 9, "failed", 0), (2, 10, "done", 5), (4, 1, "retry", 8)], OUTCOMES)
    assert rows(run(), "work", "at", "status", "content", "conflicts") == [(1, 0, "done", 7, 0), (2, 2, "done", 5, 2), (3, 1, "failed", 0, 0), (4, 1, "retry", 8, 0)]
    kept = spark.read.parquet(f"{folder}/out")
    assert rows(kept.groupBy("batch").count(), "count") == [(3,), (4,)]  # a batch writes its own keys alone


def test_readiness_once_late_rows_and_stuck_keys(spark):
    folder = scratch.shared_folder(spark, "pieces")
    schema = "key string, piece string, total long"

    def run():
        stream = arrivals.open_stream(spark, f"{folder}/in")
        return arrivals.drain_keyed(arrivals.readiness(stream, "key", "piece", "total", stuck_ms=3000), f"{folder}/checkpoint", f"{folder}/out")

    put(spark, f"{folder}/in", [("a", "1", 2), ("a", "1", 2), ("a", "2", 2), ("b", "1", 3), ("b", None, 3), ("c", "1", None), ("d", "1", 1)], schema)
    assert rows(run(), "key", "expected", "stuck") == [("a", 2, False), ("d", 1, False)]
    put(spark, f"{folder}/in", [("a", "3", 2), ("b", "2", 3), ("d", "1", 1)], schema)
    assert rows(run().where("not stuck"), "key", "expected", "stuck") == [("a", 2, False), ("d", 1, False)]
    time.sleep(3.5)
    put(spark, f"{folder}/in", [("e", "1", 5)], schema)
    assert {("b", 3, True), ("c", 0, True)} <= set(rows(run(), "key", "expected", "stuck"))
    put(spark, f"{folder}/in", [("b", "3", 3)], schema)
    assert ("b", 3, False) in rows(run(), "key", "expected", "stuck")
