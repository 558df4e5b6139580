"""Joins and links between turns, entities, agendas and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context(turns: DataFrame, hits: DataFrame, before: int, after: int) -> DataFrame:
    """Turns of a hit's group within ``before`` and ``after`` of it.

    Offsets are exploded on the hit side, so the band join is an equi-join on (group, seq).
    """
    wanted = hits.select("turn_id", "group_id", "seq", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("delta"))
    wanted = wanted.select(F.col("turn_id").alias("hit"), "group_id", (F.col("seq") + F.col("delta")).alias("seq"), F.col("delta").cast("long").alias("delta"))
    return wanted.join(turns.select("group_id", "seq", "turn_id", "role"), ["group_id", "seq"]).select("hit", "turn_id", "delta", "role")


def adjacent(turns: DataFrame) -> DataFrame:
    order = Window.partitionBy("group_id").orderBy("seq")
    return turns.withColumns({"previous": F.lag("turn_id").over(order), "next": F.lead("turn_id").over(order), "previous_text": F.lag("text").over(order), "next_text": F.lead("text").over(order)})


def question_answer_relations(turns: DataFrame, is_question: Column, answer_roles: list[str]) -> DataFrame:
    """QUESTION_TO and ANSWER_TO between a question and the adjacent answer; FOLLOW_UP_TO by the same speaker."""
    order = Window.partitionBy("group_id").orderBy("seq")
    lead = lambda c, n: F.lead(c, n).over(order)
    seen = turns.withColumn("asks", is_question).select(
        "turn_id", "role", "asks", lead("turn_id", 1).alias("next_id"), lead("role", 1).alias("next_role"),
        lead("turn_id", 2).alias("third_id"), lead("role", 2).alias("third_role"), lead("asks", 2).alias("third_asks"),
    )
    answered = F.col("asks") & F.col("next_role").isin(answer_roles)
    edge = lambda held, a, b, kind, conf: F.when(held, F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(kind).alias("relation"), F.lit(conf).alias("confidence")))
    follow = answered & F.col("third_asks") & (F.col("third_role") == F.col("role"))
    told = F.array(edge(answered, "turn_id", "next_id", "QUESTION_TO", 0.9), edge(answered, "next_id", "turn_id", "ANSWER_TO", 0.9), edge(follow, "third_id", "turn_id", "FOLLOW_UP_TO", 0.8))
    return seen.select(F.explode(told).alias("r")).where("r is not null").select("r.*")


#: Bytes of patterns that are broadcast at a time.
PATTERN_BYTES = 4 << 20


def substring_links(texts: DataFrame, patterns: DataFrame, id_col: str, pattern_id: str, block_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Distinct pairs where a text contains a pattern verbatim; patterns of any length, in time linear in the text.

    ``texts(id, text)`` and ``patterns(pattern_id, pattern)``.  Patterns are broadcast in blocks of a checked
    size and each text runs once through a block's automaton, so no text and no candidate pair is
    moved.  An empty pattern is in every text; null texts and patterns match nothing.
    """
    import pyarrow as pa

    spark = texts.sparkSession
    frame = texts.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    own = patterns.select(F.col(pattern_id).alias("pattern_id"), F.col("pattern").cast("string").alias("pattern")).where("pattern is not null")
    size = own.agg(F.coalesce(F.sum(F.octet_length("pattern") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    kinds = [frame.schema["id"].dataType.simpleString(), own.schema["pattern_id"].dataType.simpleString()]
    found = None
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()  # about ``block_bytes``
        ids: dict[str, list] = {}
        for r in rows:
            ids.setdefault(r.pattern, []).append(r.pattern_id)
        held = spark.sparkContext.broadcast(ids)

        def search(batches, held=held):
            import ahocorasick

            automaton, everywhere = ahocorasick.Automaton(), held.value.get("", [])
            for pattern in held.value:
                if pattern:
                    automaton.add_word(pattern, pattern)
            if len(automaton):
                automaton.make_automaton()
            for batch in batches:
                for part in (batch.slice(at, 512) for at in range(0, len(batch), 512)):
                    at, hit = [], []
                    for i, text in enumerate(part.column(1)):
                        seen = {p for _, p in automaton.iter(text.as_py())} if len(automaton) else ()
                        own = {x for p in seen for x in held.value[p]} | set(everywhere)
                        at += [i] * len(own)
                        hit += own
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(hit, pattern_type)], names=["id", "pattern_id"])

        pattern_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds[1]]
        part = frame.mapInArrow(search, f"id {kinds[0]}, pattern_id {kinds[1]}")
        found = part if found is None else found.unionByName(part)
    return found.distinct().select(F.col("id").alias(id_col), F.col("pattern_id").alias(pattern_id))


def explicit_mentions(texts: DataFrame, entities: DataFrame, id_col: str, entity_col: str, least: int = 4) -> DataFrame:
    """Links from ``texts(id, text)`` to ``entities(entity, number, name)`` that hold the number, or the name of ``least`` characters or more.

    ``(id, entity, evidence, confidence)``; the number is the evidence where it occurs, else the name.
    """
    kind = entities.schema[entity_col].dataType.simpleString()
    numbers = entities.where("number is not null").select(F.concat(F.lit("n:"), F.col(entity_col).cast("string")).alias("key"), F.col("number").alias("pattern"))
    names = entities.where(F.char_length("name") >= least).select(F.concat(F.lit("t:"), F.col(entity_col).cast("string")).alias("key"), F.col("name").alias("pattern"))
    hits = substring_links(texts, numbers.unionByName(names), id_col, "key")
    told = hits.groupBy(id_col, F.expr("substring(key, 3)").cast(kind).alias(entity_col)).agg(F.bool_or(F.col("key").startswith("n:")).alias("by_number"))
    return told.join(entities, entity_col).select(id_col, entity_col, F.when(F.col("by_number"), F.col("number")).otherwise(F.col("name")).alias("evidence"), F.lit(1.0).alias("confidence"))


def admit_by_number(groups: DataFrame, accepted: DataFrame, group_col: str) -> DataFrame:
    """Each group of ``groups(group, number)`` with whether one of its numbers is in ``accepted(number)``, and why not."""
    known = accepted.select("number").distinct().withColumn("ok", F.lit(True))
    marked = groups.join(known, "number", "left").groupBy(group_col).agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("admitted"))
    return marked.withColumn("reason", F.when(~F.col("admitted"), "no_selected_proposer_bill"))


def exact_mapping(candidates: DataFrame, work: DataFrame, order: list[Column]) -> DataFrame:
    """``candidates(identity, url, ...)`` with ``outcome`` against ``work(identity, url)``.

    In this order: a later copy (by ``order``) of an identity is a duplicate, an identity without work unmapped, one with
    several ambiguous, another address a mismatch; else it is mapped.
    """
    copy = F.row_number().over(Window.partitionBy("identity").orderBy(*order))
    targets = work.groupBy("identity").agg(F.count("*").alias("targets"), F.min("url").alias("work_url"))
    outcome = F.when(F.col("copy") > 1, "duplicate").when(F.col("targets").isNull(), "unmapped").when(F.col("targets") > 1, "ambiguous").when(~F.col("url").eqNullSafe(F.col("work_url")), "url_mismatch").otherwise("mapped")
    return candidates.withColumn("copy", copy).join(targets, "identity", "left").withColumn("outcome", outcome).drop("copy", "targets", "work_url")


def title_key(title: Column) -> Column:
    """Lower case, runs of white space one space: titles are compared by it."""
    return F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))


def bind_titles(turns: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """``turns(<keys>, group_id, title, number)`` against ``items(group_id, title, number)``: one row for each turn whose title one item has.

    Bound only where the exact number agrees on one item, ambiguous where on several, else inferred and unresolved.
    """
    asked = turns.select(*dict.fromkeys([*keys, "group_id", "title"]), title_key(F.col("title")).alias("key"), F.col("number").alias("asked_number"))
    known = items.select("group_id", title_key(F.col("title")).alias("key"), "number")
    agreed = F.count(F.when(F.col("number") == F.col("asked_number"), 1))
    counted = asked.join(known, ["group_id", "key"]).groupBy(*dict.fromkeys([*keys, "group_id", "title", "asked_number"])).agg(agreed.alias("agreed"), F.count("*").alias("titles"))
    status = F.when(F.col("agreed") == 1, "bound").when(F.col("agreed") > 1, "ambiguous").otherwise("inferred_unresolved")
    return counted.withColumn("status", status).drop("agreed", "asked_number")


def overlay_status(entities: DataFrame, rows: DataFrame, order: Column, fill: list[str], overwrite: list[str]) -> DataFrame:
    """``entities(number, ...)`` overlaid by status ``rows(number, ...)``, field by field.

    Of the columns ``fill`` blanks take the first non-blank value by ``order``; those of ``overwrite`` take the last
    one.  ``conflicts`` names the overwritten columns that rows differ in, comma-joined.
    """
    has = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    taken = [F.min_by(F.col(c), F.when(has(c).isNotNull(), order)).alias(f"{c}_first") for c in fill] + [F.max_by(F.col(c), F.when(has(c).isNotNull(), order)).alias(f"{c}_last") for c in overwrite]
    differ = [F.when(F.count_distinct(has(c)) > 1, c) for c in overwrite]
    told = rows.groupBy("number").agg(*taken, F.concat_ws(",", *differ).alias("conflicts"))
    joined = entities.join(told, "number", "left")
    new = {c: F.coalesce(has(c), F.col(f"{c}_first")) for c in fill} | {c: F.coalesce(F.col(f"{c}_last"), has(c)) for c in overwrite}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in entities.columns), F.coalesce("conflicts", F.lit("")).alias("conflicts"))


def title_gaps(items: DataFrame, accepted: DataFrame) -> DataFrame:
    """``items(..., title)`` without a number: a gap each, by how many ``accepted(title, number)`` have the title; never a link."""
    titles = accepted.groupBy(title_key(F.col("title")).alias("key")).agg(F.count_distinct("number").alias("n"))
    gap = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "inferred_unresolved").otherwise("ambiguous")
    return items.withColumn("key", title_key(F.col("title"))).join(titles, "key", "left").withColumn("gap", gap).drop("key", "n")


def bind_documents(docs: DataFrame, meetings: DataFrame, agenda: DataFrame) -> DataFrame:
    """``docs(..., url, numbers)`` bound to the one meeting of their address, with the numbers of both.

    ``meetings(group_id, url)``, ``agenda(group_id, number)``; ``numbers`` of a document is an array, perhaps null.
    No meeting is a missing, several an ambiguous one, and neither has numbers.
    """
    known = meetings.groupBy("url").agg(F.count_distinct("group_id").alias("n"), F.min("group_id").alias("group_id"))
    listed = agenda.groupBy("group_id").agg(F.collect_set("number").alias("listed"))  # one meeting's agenda
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("bound")
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("numbers", none), F.coalesce("listed", none)))
    return docs.join(known, "url", "left").join(listed, "group_id", "left").withColumns({"status": status, "numbers": F.when(F.col("n") == 1, both)}).drop("n", "listed")


def enforce_exact(wanted: DataFrame, entities: DataFrame, links: DataFrame, turns: DataFrame, timeline: DataFrame, inventory: DataFrame) -> dict[str, DataFrame]:
    """What the exact numbers that queries ask for reach, each table cut down to it; queries that ask for none keep all.

    ``wanted(query_id, number)``, ``entities(query_id, number)``, ``links(query_id, number, turn_id)``,
    ``turns(query_id, turn_id, ...)``, ``timeline`` and ``inventory(query_id, number, ...)``.  Entities, then
    links, turns, timeline and inventory; threads are made of the turns that are left.
    """
    asked = wanted.select("query_id").distinct()

    def keep(rows: DataFrame, reached: DataFrame, key: str) -> DataFrame:
        free = rows.join(asked, "query_id", "left_anti")
        return free.unionByName(rows.join(asked, "query_id", "left_semi").join(reached, ["query_id", key], "left_semi"))

    kept = {"entities": keep(entities, wanted, "number")}
    kept["links"] = keep(links, kept["entities"], "number")
    kept["turns"] = keep(turns, kept["links"], "turn_id")
    return kept | {"timeline": keep(timeline, kept["entities"], "number"), "inventory": keep(inventory, kept["entities"], "number")}


#: Places of a group that thread ranges and turns are joined by.
SWEEP = 64


def threads(hits: DataFrame, turns: DataFrame, gap: int = 8, pad: int = 2, block: int = SWEEP) -> DataFrame:
    """Hits of a group whose sequence gaps are at most ``gap`` form a thread, widened by ``pad`` turns.

    ``(group_id, thread, first_seq, last_seq, n_hits, participants, n_turns)``; participants in order
    of first appearance.  Ranges and turns meet by group and aligned block of ``block`` places, so a turn is held
    against the threads of its block alone, and roles are counted before they are listed.
    """
    order = Window.partitionBy("group_id").orderBy("seq")
    new = F.coalesce((F.col("seq") - F.lag("seq").over(order) > gap).cast("int"), F.lit(1))
    numbered = hits.select("group_id", "seq").withColumn("new", new).withColumn("thread", F.sum("new").over(order))
    spans = numbered.groupBy("group_id", "thread").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_hits"))
    inside = swept(spans, turns, pad, block)
    roles = inside.groupBy("group_id", "thread", "first_seq", "last_seq", "n_hits", "role").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    told = roles.groupBy("group_id", "thread", "first_seq", "last_seq", "n_hits").agg(F.array_sort(F.collect_list(F.struct("at", "role"))).alias("told"), F.sum("n").alias("n_turns"))  # one of each role
    people = F.array_join(F.transform("told", lambda x: x["role"]), ",")
    return told.select("group_id", "thread", "first_seq", "last_seq", "n_hits", people.alias("participants"), "n_turns")


def swept(spans: DataFrame, turns: DataFrame, pad: int, block: int) -> DataFrame:
    """``spans`` with ``at`` and ``role`` of each turn from ``first_seq - pad`` to ``last_seq + pad``."""
    low, high = F.col("first_seq") - pad, F.col("last_seq") + pad
    blocks = F.explode(F.sequence(F.floor(low / block).cast("long"), F.floor(high / block).cast("long")))
    placed = turns.select("group_id", F.col("seq").alias("at"), "role", F.floor(F.col("seq") / block).cast("long").alias("block"))
    return spans.withColumn("block", blocks).join(placed, ["group_id", "block"]).where(F.col("at").between(low, high)).drop("block")


def interval_scope(dates: DataFrame, intervals: DataFrame, day: str) -> DataFrame:
    """Each row with the interval (``scope, day_from, day_to``) its day lies in; null in gaps."""
    inside = F.col(day).between(F.col("day_from"), F.col("day_to"))
    return dates.join(F.broadcast(intervals), inside, "left")  # a handful of terms of office


def intersecting_scopes(ranges: DataFrame, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Each row with ``scopes``, the sorted scopes of all intervals that its range from ``low`` to ``high`` meets; null bounds are open."""
    listed = [(r.scope, r.day_from, r.day_to) for r in intervals.collect()]  # a handful of terms of office
    meets = [F.when((F.col(low).isNull() | (F.col(low) <= F.lit(b))) & (F.col(high).isNull() | (F.col(high) >= F.lit(a))), F.lit(scope)) for scope, a, b in listed]
    return ranges.withColumn("scopes", F.array_sort(F.array_compact(F.array(*meets))))
