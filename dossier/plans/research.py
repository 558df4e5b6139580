"""User-facing compositions: every stage is a DataFrame over a whole query table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators import search
from dossier.operators.filters import structured
from dossier.scratch import written
from dossier.views import Tables


def search_speeches(t: Tables, k: int = 10, **filters) -> DataFrame:
    """Hybrid search over the turns that meet the eight filters, with matched terms, neighbours and citation.

    The filters hold before either list is cut; texts join last, for the rows that remain.
    """
    from dossier.catalog.searching import fused, shown

    within = structured(t.turns, **filters).select("turn_id") if filters else None
    return shown(t, fused(t, within=within).where(F.col("rank") <= k))


def issue_hits(t: Tables, k: int = 30) -> DataFrame:
    """``(query_id, turn_id)``: the ``k`` best turns of each query by hybrid search."""
    from dossier.catalog.searching import fused

    return fused(t, k).where(F.col("rank") <= k).select("query_id", F.col("item").alias("turn_id"))


def linked_entities(t: Tables, hits: DataFrame) -> DataFrame:
    """``(query_id, turn_id, number, confidence)``: what the turns found are linked to, known entities alone."""
    return hits.join(t.links.select("turn_id", "number", "confidence"), "turn_id").join(t.entities.select("number").distinct(), "number", "left_semi")


def explore_issue(t: Tables, hits: DataFrame, linked: DataFrame, wanted: DataFrame, sources: DataFrame, gap: int = 3) -> DataFrame:
    """One row a query: turns found, entities of the best tier, threads, timeline, span and quality.

    Queries that ask for exact numbers, ``wanted(query_id, number)``, keep only what those reach: entities,
    links, turns, and the threads, timeline and quality made of them.  ``sources(group_id, url)`` are the
    meetings whose record can be cited.
    """
    from dossier.functions.labels import suspect_name
    from dossier.operators.aggregation import quality
    from dossier.operators.linking import enforce_exact

    pairs = linked.select("query_id", "number").distinct()
    empty = pairs.limit(0)
    kept = enforce_exact(wanted, pairs, linked, hits, empty, empty)
    links, turns = kept["links"], kept["turns"]
    per = links.groupBy("query_id", "number").agg(F.max("confidence").alias("confidence"), F.count_distinct("turn_id").alias("turns"))
    known = per.join(t.entities.select("number", "result", "proposed_at", "processed_at"), "number")
    best = per.groupBy("query_id").agg(F.max("confidence").alias("confidence"))
    core = known.join(best, ["query_id", "confidence"])
    order = Window.partitionBy("query_id").orderBy(F.desc("turns"), F.desc("proposed_at"), "number")
    bills = core.withColumn("k", F.row_number().over(order)).groupBy("query_id").agg(F.count("*").alias("bills"), F.max(F.when(F.col("k") == 1, F.col("number"))).alias("top_bill"), F.count("result").alias("processed"))
    dates = core.select("query_id", F.explode(F.array_compact(F.array("proposed_at", "processed_at"))).alias("day"))
    debates = links.join(core.select("query_id", "number"), ["query_id", "number"]).join(t.turns.select("turn_id", "held_on"), "turn_id").select("query_id", F.col("held_on").alias("day"))
    timeline = dates.unionByName(debates).groupBy("query_id").agg(F.count("*").alias("events"), F.min("day").alias("first_event"), F.max("day").alias("last_event"))
    placed = turns.join(t.turns.select("turn_id", "group_id", "seq", "held_on", "speaker"), "turn_id").join(sources.select("group_id", "url"), "group_id", "left")
    starts = F.coalesce((F.col("seq") - F.lag("seq").over(Window.partitionBy("query_id", "group_id").orderBy("seq")) > gap).cast("int"), F.lit(1))
    suspect = suspect_name(F.col("speaker"), ".*", 1000, ["system"])
    told = placed.withColumn("starts", starts).groupBy("query_id").agg(
        F.count("*").alias("speeches"), F.sum("starts").alias("threads"), F.count_distinct("group_id").alias("meetings"), F.min("held_on").alias("first_day"), F.max("held_on").alias("last_day"),
        F.avg(F.col("url").isNotNull().cast("int")).alias("provenance"), F.count_distinct(F.when(suspect, F.col("speaker"))).alias("suspects"),
    )
    joined = told.join(bills, "query_id", "left").join(timeline, "query_id", "left").fillna(0, ["bills", "processed", "events"])
    scores = quality(joined, "query_id").select("query_id", F.col("score").alias("quality"))
    exact = wanted.select("query_id").distinct().withColumn("exact", F.lit(True))
    out = joined.drop("provenance", "suspects").join(scores, "query_id").join(exact, "query_id", "left")
    return out.withColumn("exact", F.coalesce("exact", F.lit(False)))


def search_bills(t: Tables, wanted: DataFrame, k: int) -> DataFrame:
    """``entity_search`` over the entities' names and their documents, with each entity's status and the number of turns that are linked to it."""
    found = search.entity_search(t.indexed("entities"), t.indexed("documents"), t.bill_texts.select("doc_id", "number"), t.entities, wanted, k)
    about = t.links.groupBy("number").agg(F.count_distinct("turn_id").alias("turns"))
    status = t.entities.select("number", F.coalesce("result", F.lit("pending")).alias("status"))
    return found.join(status, "number").join(about, "number", "left").select("query_id", "number", "part", "rank", "status", F.coalesce("turns", F.lit(0)).alias("turns"))


def build_corpus(items: DataFrame, outcomes: DataFrame, root: str) -> DataFrame:
    """Coverage of each scope ``(term, kind)``, and a revision of each that is complete under ``root``.

    ``items(term, kind, item)`` is the work, ``outcomes(term, kind, item, outcome)`` with success, permanent or
    retryable what came of it.  Documents of all complete scopes are written at once, by scope; their manifests, with a name
    that is a hash of the scope's content, are one table that is written last, so a scope without a line in it does not exist.
    """
    state = lambda s: F.count(F.when(F.col("outcome") == s, 1))
    scope = ["term", "kind"]
    done = outcomes.groupBy(*scope).agg(state("success").alias("built"), state("permanent").alias("failed"), state("retryable").alias("pending"))
    cells = items.groupBy(*scope).agg(F.count("*").alias("expected")).join(done, scope, "left").fillna(0, ["built", "failed", "pending"])
    cells = written(cells.withColumn("complete", (F.col("failed") == 0) & (F.col("pending") == 0) & (F.col("expected") == F.col("built"))), "scopes")
    docs = outcomes.where("outcome = 'success'").join(cells.where("complete").select(*scope), scope, "left_semi").select("item", F.sha2("item", 256).alias("digest"), *scope)
    docs.write.partitionBy(*scope).parquet(f"{root}/documents")
    spark = items.sparkSession
    stored = spark.read.schema(docs.schema).parquet(f"{root}/documents") if cells.where("complete").take(1) else docs.limit(0)
    line = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", "item", "digest"), 256), 1, 15), 16, 10).cast("long")
    named = F.concat_ws("|", F.count("*"), F.bit_xor(line), F.sum(line % 1000003))
    stored.groupBy(*scope).agg(F.left(F.sha2(named, 256), F.lit(16)).alias("revision"), F.count("*").alias("documents")).write.parquet(f"{root}/manifests")
    published = spark.read.schema("term long, kind string, revision string, documents long").parquet(f"{root}/manifests")
    told = cells.join(published, scope, "left").select(*scope, "expected", "built", "failed", "pending", "complete", F.coalesce("documents", F.lit(0)).alias("published"))
    return told.withColumn("term", F.col("term").cast("long"))


def bill_status(t: Tables) -> DataFrame:
    """Every entity with its status and what is said about it."""
    about = t.links.groupBy("number").agg(F.count_distinct("turn_id").alias("turns"), F.max("held_on").alias("last_debate"), F.max_by("turn_id", F.struct("confidence", "held_on", "turn_id")).alias("best_turn"))
    return t.entities.join(about, "number", "left").select("number", F.coalesce("result", F.lit("pending")).alias("status"), F.coalesce("turns", F.lit(0)).alias("turns"), "last_debate", "best_turn")


def overview(records: DataFrame, bound: DataFrame, known: DataFrame, axes: list[str], k: int) -> DataFrame:
    """Per entity of ``known(number)``: records, histogram of axes, core of ``k`` and representative.

    ``bound(number, evidence_type, id, sort_key)``.  The core takes one record of every axis in the order
    of ``axes`` (the latest status, else the earliest), then fills by axis, sort key and id.
    """
    own = bound.join(known.distinct(), "number", "left_semi")
    counts = own.groupBy("number", "evidence_type").agg(F.count("*").alias("n"))
    types = F.array_join(F.array_sort(F.collect_list(F.concat("evidence_type", F.lit(":"), F.col("n").cast("string")))), ",")  # an axis each
    per = counts.groupBy("number").agg(F.sum("n").alias("records"), types.alias("types"))
    priority = F.array_position(F.lit(axes), F.col("evidence_type"))
    axis = Window.partitionBy("number", "evidence_type")
    first = F.when(F.col("evidence_type") == "bill_status", F.row_number().over(axis.orderBy(F.desc("sort_key"), "id"))).otherwise(F.row_number().over(axis.orderBy("sort_key", "id"))) == 1
    place = F.row_number().over(Window.partitionBy("number").orderBy(~F.col("first"), "priority", "sort_key", "id"))
    core = own.withColumns({"first": first, "priority": priority}).withColumn("place", place).where(F.col("place") <= k)
    named = F.concat("evidence_type", F.lit("/"), "id")
    listed = F.array_sort(F.collect_list(F.struct("place", named.alias("name"))))  # ``k`` at most
    chosen = core.groupBy("number").agg(F.array_join(F.transform(listed, lambda x: x["name"]), " ").alias("core"), F.max(F.when(F.col("place") == 1, named)).alias("representative"))
    return per.join(chosen, "number").select("number", "records", "types", "core", "representative")


def run(records: DataFrame, verdicts: DataFrame, graph: tuple[DataFrame, DataFrame], entities: DataFrame, meetings: DataFrame) -> DataFrame:
    """The ledger of one research run, a row an axis.

    A record is matched if the entity and the meeting that it names are known; an axis is complete only if
    all its records are, the sources were collected whole, and the graph has no unresolved claim.
    """
    known = entities.select("number").distinct().withColumn("has_bill", F.lit(True))
    held = meetings.select(F.col("group_id").alias("meeting")).distinct().withColumn("has_meeting", F.lit(True))
    joined = records.join(known, "number", "left").join(held, "meeting", "left")
    sound = (F.col("number").isNull() | F.col("has_bill").isNotNull()) & (F.col("meeting").isNull() | F.col("has_meeting").isNotNull())
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", "evidence_type", "id", "sort_key"), 256), 1, 15), 16, 10).cast("long")
    axes = joined.groupBy("evidence_type").agg(F.count("*").alias("checked"), F.count(F.when(sound, 1)).alias("matched"), F.bit_xor(digest).alias("xored"))
    axes = written(axes, "axes")  # a row an axis
    edges, rest = graph
    whole = verdicts.agg(F.bool_and("coherent").alias("whole"))
    nets = edges.agg(F.count("*").alias("edges")).join(rest.agg(F.count("*").alias("unresolved"), F.count_distinct("gap").alias("gap_kinds"))).join(whole)  # single rows
    snapshot = axes.agg(F.bit_xor("xored").alias("snapshot"))
    complete = (F.col("checked") == F.col("matched")) & F.col("whole") & (F.col("unresolved") == 0)
    return axes.join(F.broadcast(nets.join(snapshot))).select(  # one row
        F.col("evidence_type").alias("axis"), "checked", "matched", (F.col("checked") - F.col("matched")).alias("rejected"), complete.alias("complete"), "edges", "unresolved", "gap_kinds", "snapshot"
    )
