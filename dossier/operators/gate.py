"""The explainable relevance gate: hard gates in order, points with reasons, tiers and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import match_key
from dossier.scratch import written

#: Points for a term found in title, agenda or body, by the kind of term; fixed values.
WEIGHTS = {"statute": (36, 40, 24), "issue": (30, 34, 22), "related_statute": (12, 14, 6), "related_issue": (11, 13, 5)}
EXACT = 100  # for a requested number, and for each requested proposer
MINIMUM = 10
ROLES = ["representative", "co", "any"]


#: Rows of best tiers, chosen candidates and met proposers up to which they are broadcast, so no decision is moved for them.
FEW_ROWS = 250_000


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def match_proposers(offered: DataFrame, wanted: DataFrame) -> DataFrame:
    """``offered(candidate, role, name)`` held against ``wanted(query_id, role, name)``, role ``any`` for either.

    Names are equal whole; of one role any name will do, and every role that a query asks for has to be
    met.  One row for each query and candidate that share a name: ``all_met``, the number of ``names``
    met, the first role that is ``missing``, and the ``reasons``; who proposes alone and with others
    counts as the representative.
    """
    names = wanted.select("name").distinct()  # who offers another name is not grouped
    own = offered.join(names, "name", "left_semi").groupBy("candidate", "name").agg(F.bool_or(F.col("role") == "representative").alias("leads"), F.bool_or(F.col("role") == "co").alias("joins"))
    asked = wanted.select("query_id", F.col("role").alias("asked"), "name").distinct()
    fits = ((F.col("asked") == "representative") & F.col("leads")) | ((F.col("asked") == "co") & F.col("joins")) | (F.col("asked") == "any")
    label = F.when(F.col("asked") != "any", F.col("asked")).when(F.col("leads"), "representative").otherwise("co")
    hits = own.join(asked, "name").select("query_id", "candidate", "asked", fits.alias("fits"), F.when(fits, F.concat(F.lit("proposer:"), label, F.lit(":"), "name")).alias("reason"))
    met = hits.groupBy("query_id", "candidate").agg(F.collect_set(F.when(F.col("fits"), F.col("asked"))).alias("met"), F.count(F.when(F.col("fits"), 1)).alias("names"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    roles = asked.groupBy("query_id").agg(F.collect_set("asked").alias("roles"))
    missing = F.get(F.filter(F.lit(ROLES), lambda r: F.array_contains("roles", r) & ~F.array_contains("met", r)), F.lit(0))
    return met.join(roles, "query_id").select("query_id", "candidate", missing.isNull().alias("all_met"), "names", missing.alias("missing"), F.array_join("reasons", ",").alias("reasons"))


def relevance_gate(candidates: DataFrame, terms: DataFrame, scopes: DataFrame, offered: DataFrame | None = None, proposers: DataFrame | None = None) -> DataFrame:
    """Score every candidate of every query and say why it is accepted or rejected.

    ``candidates(query_id, candidate, kind, number, committee, day, proposed_on, title, agenda, body)`` with
    title, agenda and body as match keys; ``kind`` is entity or event.  ``terms(query_id, kind, term)``.
    ``scopes(query_id, numbers, committee, day_from, day_to, proposal_dated)``, null for no constraint;
    ``numbers`` is an array.  ``offered(candidate, role, name)`` and ``proposers(query_id, role, name)``.

    Hard gates come in order: number, committee (equal or one within the other, as match keys), date,
    proposer.  A query's dates hold for events by their day; for entities only if the query is about
    proposal dates, and then by the day of proposal.  Proposers bind entities alone.
    """
    c = F.col
    wants = scopes.select("query_id", c("numbers").alias("want_numbers"), match_key(c("committee")).alias("want_committee"), c("day_from").alias("want_from"), c("day_to").alias("want_to"), F.coalesce("proposal_dated", F.lit(False)).alias("by_proposal"))
    scoped = candidates.join(wants, "query_id")
    own = match_key(c("committee"))
    committee = c("want_committee").isNull() | F.coalesce(F.contains(own, c("want_committee")) | (F.contains(c("want_committee"), own) & (own != "")), F.lit(False))
    entity = c("kind") == "entity"
    dated = (c("want_from").isNotNull() | c("want_to").isNotNull()) & (~entity | c("by_proposal"))
    day = F.when(entity, c("proposed_on")).otherwise(c("day"))
    inside = (c("want_from").isNull() | (day >= c("want_from"))) & (c("want_to").isNull() | (day <= c("want_to")))
    asked = c("want_numbers").isNotNull()
    if proposers is not None:
        binds = proposers.select("query_id").distinct().withColumn("by_proposer", F.lit(True))
        met = written(match_proposers(offered, proposers).withColumnRenamed("reasons", "proposer_reasons"), "met-proposers")
        scoped = scoped.join(binds, "query_id", "left").join(_few(met), ["query_id", "candidate"], "left")
    else:
        for name, kind in (("by_proposer", "boolean"), ("all_met", "boolean"), ("names", "long"), ("missing", "string"), ("proposer_reasons", "string")):
            scoped = scoped.withColumn(name, F.lit(None).cast(kind))
    bound = F.coalesce("by_proposer", F.lit(False)) & entity
    names = F.when(bound, F.coalesce("names", F.lit(0))).otherwise(0)
    gate = (
        F.when(asked & ~F.coalesce(F.array_contains("want_numbers", c("number")), F.lit(False)), "exact_number_mismatch").when(~committee, "committee_mismatch")
        .when(dated & day.isNull(), "missing_date").when(dated & ~inside, "outside_date_range")
        .when(bound & ~F.coalesce("all_met", F.lit(False)), F.concat(F.coalesce("missing", F.lit("any")), F.lit("_proposer_mismatch")))
    )
    gated = scoped.select("query_id", "candidate", "kind", "number", day.alias("day"), "title", "agenda", "body", gate.alias("gate"), asked.alias("asked"), bound.alias("bound"), names.alias("names"), F.when(bound, c("proposer_reasons")).alias("proposer_reasons"), (c("want_committee").isNotNull() | dated).alias("structured"))
    # a query's terms are few and stated: they ride along, so no candidate is moved for them
    listed = terms.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("kind", "term"))).alias("terms"))
    joined = gated.join(listed, "query_id", "left")

    def found(t: Column) -> Column:
        points = lambda place: F.coalesce(*(F.when(t["kind"] == kind, w[place]) for kind, w in WEIGHTS.items()), F.lit(0))
        at = F.when(F.contains("agenda", t["term"]), F.struct(points(1).alias("points"), F.lit("agenda").alias("source"))).when(F.contains("title", t["term"]), F.struct(points(0).alias("points"), F.lit("title").alias("source")))
        at = at.when(F.contains("body", t["term"]), F.struct(points(2).alias("points"), F.lit("body").alias("source")))
        return F.struct(at["points"].alias("points"), F.concat(t["kind"], F.lit(":"), t["term"], F.lit("@"), at["source"]).alias("reason"))

    matched = F.filter(F.transform(F.coalesce("terms", F.array().cast("array<struct<kind:string,term:string>>")), found), lambda m: m["points"].isNotNull())
    scored = joined.withColumn("matched", F.when(c("gate").isNull(), matched)).withColumn("meaningful", c("terms").isNotNull())
    topic = F.coalesce(F.aggregate("matched", F.lit(0), lambda s, m: s + m["points"]), F.lit(0))
    score = topic + F.when(c("asked"), EXACT).otherwise(0) + EXACT * c("names")
    alone = ~c("meaningful") & c("structured") & ~c("asked") & ~c("bound")
    rejection = (
        F.when(c("gate").isNotNull(), c("gate")).when(c("bound"), F.when(c("meaningful") & (topic < MINIMUM), "below_minimum_score")).when(c("asked") | alone, None)
        .when(~c("meaningful"), "no_meaningful_terms").when(score < MINIMUM, "below_minimum_score")
    )
    value = F.when(c("gate").isNotNull() | (rejection == "no_meaningful_terms"), 0).when(alone, MINIMUM).otherwise(score)
    exact = F.when(c("asked"), F.concat(F.lit("number:"), "number"))
    topics = F.array_join(F.array_sort(F.transform("matched", lambda m: m["reason"])), ",")
    reasons = F.concat_ws(",", exact, F.nullif(c("proposer_reasons"), F.lit("")), F.nullif(topics, F.lit("")), F.when(alone, "structured_scope_only"))
    return scored.select("query_id", "candidate", "number", "day", value.cast("long").alias("score"), rejection.isNull().alias("accepted"), F.when(c("gate").isNull(), reasons).otherwise("").alias("reasons"), rejection.alias("rejection"))


def order() -> list[Column]:
    """The order in which decisions of one query are ranked."""
    return [F.desc("score"), F.desc_nulls_last("day"), F.asc("number"), F.asc("candidate")]


def tier(reasons: Column) -> Column:
    """0 to 6: a canonical term in title or agenda, a related one there, either in the body, other terms, nothing.

    Canonical are the kinds statute and issue, related the kinds named so.
    """
    has = lambda pattern: reasons.rlike(rf"(?:^|,)(?:{pattern})(?:,|$)")
    own, near, named, inner = "(?:statute|issue):[^,]*", "related_(?:statute|issue):[^,]*", "@(?:title|agenda)", "@body"
    out = F.when(has(own + named), 0).when(has(near + named), 1).when(has(own + inner), 2).when(has(near + inner), 3)
    return out.when(has("[^,]*" + named), 4).when(has("[^,]*" + inner), 5).otherwise(6).cast("long")


def tier_select(decisions: DataFrame, k: int) -> DataFrame:
    """Every decision with its tier and flags: accepted, eligible (of its query's best tier), selected (the k best of those)."""
    tiered = written(decisions.select("query_id", "candidate", "number", "day", "score", "accepted", tier(F.col("reasons")).alias("tier")), "tiers")  # read three times
    best = written(tiered.where("accepted").groupBy("query_id").agg(F.min("tier").alias("best")), "best-tiers")
    eligible = tiered.join(_few(best), "query_id", "left").withColumn("eligible", F.coalesce(F.col("accepted") & (F.col("tier") == F.col("best")), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order()))
    chosen = written(eligible.where("eligible").withColumn("place", place).where(F.col("place") <= k).select("query_id", "candidate", F.lit(True).alias("chosen")), "chosen")
    return eligible.join(_few(chosen), ["query_id", "candidate"], "left").select("query_id", "candidate", "tier", "accepted", "eligible", F.coalesce("chosen", F.lit(False)).alias("selected"))


def promote(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """Rejected decisions that an exact full-text hit ``hits(query_id, candidate)`` proves are accepted, with the reason.

    Only a rejection for want of points is overruled, never a hard gate.  No row is lost or repeated.
    """
    proven = hits.select("query_id", "candidate").distinct().withColumn("proven", F.lit(True))
    joined = decisions.join(proven, ["query_id", "candidate"], "left")
    lifted = F.coalesce(F.col("proven") & F.col("rejection").isin("below_minimum_score", "no_meaningful_terms"), F.lit(False))
    return joined.select(
        "query_id", "candidate", "number", "day", "score", (F.col("accepted") | lifted).alias("accepted"), F.when(lifted, F.concat_ws(",", F.nullif("reasons", F.lit("")), F.lit("corpus_exact_hit"))).otherwise(F.col("reasons")).alias("reasons"),
        F.when(~lifted, F.col("rejection")).alias("rejection"), lifted.alias("promoted"),
    )


def group_relevance(groups: DataFrame, topics: DataFrame, group_col: str, text_col: str, day_col: str, offset: int, limit: int, bonus: int = 5) -> DataFrame:
    """Groups ranked for each query: a point for every topic term their text holds, ``bonus`` if it holds the query's committee.

    ``topics(query_id, terms, committee)``; later days, then larger group ids come first; ranks ``offset`` + 1 to ``offset`` + ``limit`` stay.
    Texts meet the terms in one automaton.  Groups without a point are only candidates if they are among the latest
    ``offset`` + ``limit``, for no other can come into the ranks.
    """
    from dossier.operators.linking import substring_links

    low = groups.select(group_col, F.lower(text_col).alias("text"))
    asked = topics.select("query_id", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("word"), F.lit(1).alias("points"))
    asked = asked.unionByName(topics.where("committee is not null").select("query_id", F.lower("committee").alias("word"), F.lit(bonus).alias("points")))
    words = asked.select("word", F.col("word").alias("pattern")).distinct()
    points = substring_links(low, words, group_col, "word").join(asked, "word").groupBy("query_id", group_col).agg(F.sum("points").alias("relevance"))
    latest = groups.select(F.struct(F.col(day_col).alias("day"), F.col(group_col).alias("id")).alias("g")).orderBy(F.desc_nulls_last("g.day"), F.desc("g.id")).limit(offset + limit)
    few = [r.g.id for r in latest.collect()]
    none = topics.select("query_id", F.explode(F.lit(few).cast(f"array<{groups.schema[group_col].dataType.simpleString()}>")).alias(group_col), F.lit(0).cast("long").alias("relevance"))
    every = points.unionByName(none).groupBy("query_id", group_col).agg(F.max("relevance").cast("long").alias("relevance"))
    scored = every.join(groups.select(group_col, day_col), group_col)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc_nulls_last(day_col), F.desc(group_col)))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= offset + limit).where(F.col("rank") > offset)


def infer_committee(text: Column, names: list[str], hints: list[tuple[str, list[str]]]) -> Column:
    """The first committee named in the text, else the first of which it holds a hint; null if none."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, words in reversed(hints):
        for w in words:
            out = F.when(F.contains(low, F.lit(w.lower())), name).otherwise(out)
    for name in reversed(names):
        out = F.when(F.contains(low, F.lit(name.lower())), name).otherwise(out)
    return out


def recall(hits: DataFrame, docs: DataFrame, id_col: str, committees: list[str], day_from: str, as_of: str) -> DataFrame:
    """Per query what became of its relevant ``hits(query_id, id)``: promoted ids, counts of reasons, and whether the answer is verified.

    ``docs(id, day, committee, minutes, outcome)`` with the outcome of the exact mapping.  A missing date of minutes, a
    missing committee and any fault of the mapping are gaps, which make the answer incomplete; days and
    committees outside the scope exclude.
    """
    c, day = F.col, F.col("day")
    fate = (
        F.when(c("minutes") & day.isNull(), "missing_date").when(c("committee").isNull(), "missing_committee").when(c("minutes") & (day > F.lit(as_of).cast("date")), "after_as_of")
        .when(~c("committee").isin(committees), "outside_committee").when(c("minutes") & (day < F.lit(day_from).cast("date")), "outside_date").when(c("outcome") != "mapped", c("outcome")).otherwise("promoted")
    )
    counts = hits.join(docs, id_col).groupBy("query_id", fate.alias("fate")).agg(F.count("*").alias("n"))
    excluded = ["after_as_of", "outside_committee", "outside_date", "promoted"]
    told = F.array_join(F.array_sort(F.collect_list(F.when(c("fate") != "promoted", F.concat("fate", F.lit(":"), c("n").cast("string"))))), ",")  # a reason each
    gap = F.bool_or(~c("fate").isin(excluded))
    return counts.groupBy("query_id").agg(F.sum(F.when(c("fate") == "promoted", c("n")).otherwise(0)).alias("promoted"), told.alias("reasons"), F.when(gap, "incomplete").otherwise("verified").alias("status"))
