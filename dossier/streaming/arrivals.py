"""Structured Streaming twins: idempotent ingest, readiness, progress, threads, index maintenance.

Each function takes a streaming DataFrame and returns one; ``drain`` runs what has arrived and gives the
table that came of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dossier import scratch
from dossier.operators import index


def open_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files of a table as a stream; event times become instants, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    pattern = f"{folder}/[{name[0]}]{name[1:]}"  # as a pattern, a table may be one file or a folder of them
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def drain(stream: DataFrame, mode: str, checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Process everything available and return the rows written, with ``batch``, the number of their batch.

    A later call with the same ``checkpoint`` and ``target`` goes on where the last one ended; without them both are new.
    """
    spark = stream.sparkSession
    folder = scratch.shared_folder(spark, "stream")
    rows = target or f"{folder}/rows"

    def write(batch: DataFrame, number: int) -> None:
        # a batch done again replaces what it wrote before
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    schema = stream.schema.add("batch", "long")
    return spark.read.schema(schema).option("basePath", rows).parquet(rows) if scratch.names(spark, rows) else spark.createDataFrame([], schema)


def latest_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key: the final state of an update-mode stream."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k", "batch")


def absorb_redelivery(events: DataFrame, key: str, time: str, within: str = "30 days") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


#: What keyed streams start with: state in RocksDB, which writes what changed; no batches without rows, of which a processor with timers
#: would ask for ever more, so timers fire with the next rows.
_KEYED = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside have the settings of keyed state; the session has its own again after."""
    before = {name: spark.conf.get(name, None) for name in _KEYED}
    for name, value in _KEYED.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def drain_keyed(stream: DataFrame, checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """``drain`` in update mode for what ``outcomes_kept`` and ``readiness`` return."""
    with _keyed_state(stream.sparkSession):
        return drain(stream, "update", checkpoint, target)


def outcomes_kept(outcomes: DataFrame, key: str, order: str, status: str, content: str, terminal: list[str], ttl_ms: int | None = None) -> DataFrame:
    """The accepted outcome of each key that a batch brings something for, and how many later ones were refused so far.

    A retryable outcome gives way to whatever comes after it; a terminal one stays, and what comes after it
    with another status or content is a conflict.  Within a batch ``order`` tells what came first and repeated rows count
    once.  The state of a key is its outcome and a count, and is forgotten ``ttl_ms`` after its last change, if given.
    A batch reads and writes the state of its own keys alone.
    """
    kinds = {c: outcomes.schema[c].dataType.simpleString() for c in (key, order, status, content)}
    columns = [order, status, content]
    held = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", conflicts long"
    final, names = frozenset(terminal), [key, *columns, "conflicts"]

    class Keep(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getValueState("kept", held, ttl_ms)

        def handleInputRows(self, key, rows, timers):  # noqa: N802
            prior = tuple(self.kept.get()) if self.kept.exists() else None
            came = sorted({(r[order], r[status], r[content]) for r in rows}, key=lambda r: (r[0] is not None, r[0], str(r[1:])))
            if prior is not None and prior[1] in final:
                now, refused = prior[:3], sum(r[1:] != prior[1:3] for r in came)
            else:
                first = next((r for r in came if r[1] in final), None)
                now = first or came[-1]
                refused = sum(r[0] > first[0] and r[1:] != first[1:] for r in came) if first else 0
            state = (*now, (prior[3] if prior else 0) + refused)
            self.kept.update(state)
            yield Row(**dict(zip(names, (*key, *state))))

        def close(self) -> None:
            pass

    schema = f"`{key}` {kinds[key]}, {held}"
    return outcomes.select(*kinds).groupBy(key).transformWithState(Keep(), schema, "update", "processingTime" if ttl_ms else "none")


def absorb_outcomes(outcomes: DataFrame, key: str, order: str, status: str, content: str, terminal: list[str], checkpoint: str | None = None, target: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """``(key, order, status, content, conflicts)`` after all that is available: the last row of each key that ``outcomes_kept`` gave."""
    kept = outcomes_kept(outcomes, key, order, status, content, terminal, ttl_ms)
    return latest_state(drain_keyed(kept, checkpoint, target), [key])


def readiness(arrivals: DataFrame, key: str, piece: str, total: str, ttl_ms: int | None = None, stuck_ms: int | None = None) -> DataFrame:
    """``(key, expected, stuck)``: each key once when as many different pieces as its largest ``total`` says have come.

    A piece is an entry of the key's state, so a batch adds its own and reads no others.  Once a key is ready its pieces are
    dropped and a flag stays, for ``ttl_ms`` if given; what comes late gives nothing.  With ``stuck_ms`` a
    key that is not ready so long after its last arrival is reported as stuck by the next batch, once until more of it arrives.
    """
    kind = arrivals.schema[key].dataType.simpleString()

    class Gather(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.pieces = handle.getMapState("pieces", "piece string", "seen boolean", ttl_ms)
            self.counts = handle.getValueState("counts", "seen long, most long, due long", ttl_ms)
            self.done = handle.getValueState("done", "most long", ttl_ms)

        def handleInputRows(self, key, rows, timers):  # noqa: N802
            if self.done.exists():
                return
            seen, most, due = self.counts.get() if self.counts.exists() else (0, 0, 0)
            for r in rows:
                most = max(most, r["total"] or 0)
                if r["piece"] is not None and not self.pieces.containsKey((r["piece"],)):
                    self.pieces.updateValue((r["piece"],), (True,))
                    seen += 1
            if due:
                self.handle.deleteTimer(due)
            if 0 < most <= seen:
                self.pieces.clear()
                self.counts.clear()
                self.done.update((most,))
                yield Row(key=key[0], expected=most, stuck=False)
                return
            if stuck_ms:
                due = timers.getCurrentProcessingTimeInMs() + stuck_ms
                self.handle.registerTimer(due)
            self.counts.update((seen, most, due))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
            if self.counts.exists():
                seen, most, _ = self.counts.get()
                self.counts.update((seen, most, 0))
                yield Row(key=key[0], expected=most, stuck=True)

        def close(self) -> None:
            pass

    rows = arrivals.select(F.col(key).alias("key"), F.col(piece).cast("string").alias("piece"), F.col(total).cast("long").alias("total"))
    found = rows.groupBy("key").transformWithState(Gather(), f"key {kind}, expected long, stuck boolean", "update", "processingTime" if ttl_ms or stuck_ms else "none")
    return found.withColumnRenamed("key", key)


def progress(arrivals: DataFrame, key: str, accepted, failed, total: str) -> DataFrame:
    """Running counts per key against the largest ``total``, and whether nothing is pending any more; update mode."""
    counts = arrivals.groupBy(key).agg(F.count("*").alias("arrived"), F.count(F.when(accepted, 1)).alias("accepted"), F.count(F.when(failed, 1)).alias("failed"), F.max(total).cast("long").alias("expected"))
    pending = F.greatest(F.col("expected") - F.col("accepted") - F.col("failed"), F.lit(0))
    return counts.withColumns({"pending": pending.cast("long"), "complete": F.col("accepted") + F.col("failed") >= F.col("expected")})


def threads(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Sessions of a key whose gaps are below ``gap``, once the watermark has passed them; append mode."""
    sessions = events.withWatermark(time, "0 seconds").groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("w.start").alias("first_at"), "n")


def incremental_index(docs: DataFrame, id_col: str, text_cols: list[str], order: str, path: str | None = None, checkpoint: str | None = None) -> index.Index:
    """A stored index kept up as documents arrive, one batch at a time; each batch is a segment of its own documents.

    A document that comes again replaces its older postings (of one batch the one with the largest ``order`` counts).
    The version that a batch makes names the batch, so one done again changes nothing.  A later call with the same ``path`` and
    ``checkpoint`` goes on where the last one ended.
    """
    spark = docs.sparkSession
    folder = scratch.shared_folder(spark, "stream")
    path = path or f"{folder}/index"
    if index.opened(spark, path) is None:
        index.build(spark.createDataFrame([], docs.schema), id_col, text_cols, path)

    def write(batch: DataFrame, number: int) -> None:
        held = index.opened(spark, path)
        if held.batch < number:
            last = batch.groupBy(id_col).agg(F.max_by(F.struct(*text_cols), order).alias("last")).select(id_col, "last.*")
            index.update(held, last.select(id_col).limit(0), last, text_cols, batch=number)

    run = docs.writeStream.option("checkpointLocation", checkpoint or f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    return index.opened(spark, path)
