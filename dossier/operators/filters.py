"""Structured filters over turns: for one set of wishes, or for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.scratch import written

#: Filters by equality, and by a part of the text in any case.
EXACT = ["term", "role", "organization", "kind"]
PARTS = ["committee", "speaker"]


def structured(turns: DataFrame, **wanted) -> DataFrame:
    """Turns that meet every given filter of the eight: term, role, organization, kind exact; committee, speaker by
    substring in any case; ``day_from`` and ``day_to`` inclusive.

    A null value in a row never matches; ``day_from`` after ``day_to`` and unknown filters are errors.
    """
    if unknown := set(wanted) - {*EXACT, *PARTS, "day_from", "day_to"}:
        raise ValueError(f"no such filters: {sorted(unknown)}")
    if wanted.get("day_from") and wanted.get("day_to") and wanted["day_from"] > wanted["day_to"]:
        raise ValueError("day_from is after day_to")
    for name, value in wanted.items():
        if value is not None:
            turns = turns.where(_test(name, F.lit(value)))
    return turns


def _test(name: str, value: Column) -> Column:
    if name in EXACT:
        return F.col(name) == value
    if name in PARTS:
        return F.contains(F.lower(name), F.lower(value))
    day = value.cast("date")
    return F.col("held_on") >= day if name == "day_from" else F.col("held_on") <= day


#: Blocks that the days of a table are cut to, and buckets that queries without filters are dealt to.
DAY_BLOCKS, BUCKETS = 64, 64


def matching(turns: DataFrame, queries: DataFrame, id_col: str = "turn_id") -> DataFrame:
    """``(query_id, id)`` of the turns that meet each row of ``queries(query_id, <filters>)``; null is no constraint.

    An index over the queries: each stands under one key, the value of that of its filters which the fewest turns have, where a part of a text stands
    under every value that holds it (found once for each distinct value), a query with days alone under the blocks
    of days that it meets, and one without filters under every bucket of ids.  Turns meet queries by key in one join and
    the other filters are tested on what meets.  Queries are a table of any size; one whose ``day_from`` is after its ``day_to`` is an error.
    """
    from dossier.operators.linking import substring_links

    c, names = F.col, [n for n in queries.columns if n != "query_id"]
    if unknown := set(names) - {*EXACT, *PARTS, "day_from", "day_to"}:
        raise ValueError(f"no such filters: {sorted(unknown)}")
    days = [n for n in ("day_from", "day_to") if n in names]
    if len(days) == 2 and (wrong := queries.where(c("day_from").cast("date") > c("day_to").cast("date")).select("query_id").take(1)):
        raise ValueError(f"query {wrong[0].query_id}: day_from is after day_to")
    wishes = queries.select("query_id", *(c(n).cast("date").alias(f"_{n}") if n in days else c(n).alias(f"_{n}") for n in names))
    wishes = written(wishes.withColumn("_row", F.monotonically_increasing_id()), "filter-queries")
    low = size = None
    if days:
        low, high = turns.agg(F.min("held_on"), F.max("held_on")).first()
        size = 1 if low is None else max(1, -(-((high - low).days + 1) // DAY_BLOCKS))
    day = lambda d: F.floor(F.datediff(d, F.lit(low).cast("date")) / F.lit(size or 1)).cast("long")
    equal = [n for n in (*EXACT, *PARTS) if n in names]
    key = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("key_kind"), value.cast("string").alias("key_value")))
    keys = [key(n, c(n)) for n in equal] + ([key("day", day(c("held_on")))] if days else []) + [key("all", F.pmod(F.xxhash64(id_col), F.lit(BUCKETS)))]
    needed = dict.fromkeys([id_col, *equal, *(["held_on"] if days else [])])
    placed = turns.select(*needed, F.explode(F.array_compact(F.array(*keys))).alias("k")).select(*needed, "k.*")
    often = written(placed.where(~c("key_kind").isin("day", "all")).groupBy("key_kind", "key_value").agg(F.count("*").alias("n")), "filter-values")
    # each filter's values, and how many turns they have together
    exact = [key(n, c(f"_{n}")) for n in equal if n in EXACT]
    options = [wishes.select("_row", F.explode(F.array_compact(F.array(*exact))).alias("k")).select("_row", "k.*")] if exact else []
    for n in (n for n in equal if n in PARTS):
        asked = wishes.where(c(f"_{n}").isNotNull()).select("_row", F.lower(f"_{n}").alias("pattern"))
        held = substring_links(often.where(c("key_kind") == n).select("key_value", F.lower("key_value").alias("text")), asked.select("pattern", c("pattern").alias("p")).distinct().select(c("p"), "pattern"), "key_value", "p")
        options.append(asked.join(held, c("pattern") == c("p")).select("_row", F.lit(n).alias("key_kind"), "key_value"))
    given = F.lit(False)
    for n in equal:
        given = given | c(f"_{n}").isNotNull()
    chosen = []
    if options:
        every = options[0]
        for o in options[1:]:
            every = every.unionByName(o)
        every = written(every.join(often, ["key_kind", "key_value"], "left").select("_row", "key_kind", "key_value", F.coalesce("n", F.lit(0)).alias("n")), "filter-options")
        best = every.groupBy("_row", "key_kind").agg(F.sum("n").alias("n")).groupBy("_row").agg(F.min(F.struct("n", "key_kind")).alias("b")).select("_row", c("b.key_kind").alias("key_kind"))
        chosen.append(every.join(best, ["_row", "key_kind"]).select("_row", "key_kind", "key_value"))
    dated = F.lit(False)
    for n in days:
        dated = dated | c(f"_{n}").isNotNull()
    if days and low is not None:
        first = F.greatest(F.coalesce(day(c("_day_from")), F.lit(0)) if "day_from" in days else F.lit(0).cast("long"), F.lit(0))
        last = F.least(F.coalesce(day(c("_day_to")), F.lit(DAY_BLOCKS)) if "day_to" in days else F.lit(DAY_BLOCKS).cast("long"), F.lit(DAY_BLOCKS).cast("long"))
        blocks = F.explode(F.when(first <= last, F.transform(F.sequence(first, last), lambda b: b.cast("string"))))
        chosen.append(wishes.where(~given & dated).select("_row", F.lit("day").alias("key_kind"), blocks.alias("key_value")))
    chosen.append(wishes.where(~given & ~dated).select("_row", F.lit("all").alias("key_kind"), F.explode(F.lit([str(b) for b in range(BUCKETS)])).alias("key_value")))
    under = chosen[0]
    for o in chosen[1:]:
        under = under.unionByName(o)
    met = F.lit(True)
    for n in names:
        met = met & (c(f"_{n}").isNull() | F.coalesce(_test(n, c(f"_{n}")), F.lit(False)))
    return placed.join(under.join(wishes, "_row"), ["key_kind", "key_value"]).where(met).select("query_id", id_col)


def collapse_months(months: DataFrame, group: list[str], as_of: str) -> DataFrame:
    """``months(<group>, y, mo)`` to keys: a year with all its months, or the year of ``as_of`` with all that have passed, is one key."""
    years = months.groupBy(*group, "y").agg(F.array_sort(F.collect_set("mo")).alias("months"))  # twelve at most
    today = F.lit(as_of).cast("date")
    passed = F.when(F.col("y") == F.year(today), F.month(today)).otherwise(12)
    whole = F.size(F.filter("months", lambda m: m <= passed)) == passed
    month = lambda m: F.concat(F.col("y").cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"))
    keys = F.when(whole, F.array(F.col("y").cast("string"))).otherwise(F.transform("months", month))
    return years.select(*group, "y", F.explode(keys).alias("key"))


def strict_family(rows: DataFrame, day: Column | None, committee: Column, day_from: str, day_to: str, wanted: str) -> DataFrame:
    """``rows`` with ``cause``, the first hard filter that drops them, null for kept ones; without a ``day`` dates do not count."""
    low, high = (F.lit(d).cast("date") for d in (day_from, day_to))
    dated = F.lit(None).cast("string") if day is None else F.when(day.isNull(), "missing_date").when(~day.between(low, high), "outside_range")
    held = F.when(F.coalesce(F.trim(committee), F.lit("")) == "", "missing_committee").when(~F.contains(F.lower(committee), F.lit(wanted.lower())), "committee_mismatch")
    return rows.withColumn("cause", F.coalesce(dated, held))


def proposal_scope(entities: DataFrame, inventory: DataFrame, links: DataFrame, threads: DataFrame, day_from: str, day_to: str) -> dict[str, DataFrame]:
    """Entities proposed within the range (undated ones are not), and what of ``inventory(number)``, ``links(number, turn_id, ...)``
    and ``threads(thread, turn_id)`` they reach."""
    kept = entities.where(F.col("proposed_at").between(F.lit(day_from).cast("date"), F.lit(day_to).cast("date")))
    own = links.join(kept.select("number"), "number", "left_semi")
    return {"entities": kept, "inventory": inventory.join(kept.select("number"), "number", "left_semi"), "links": own, "threads": threads.join(own.select("turn_id").distinct(), "turn_id", "left_semi")}


def derived_months(matched: DataFrame, queries: DataFrame, today: str, ends: DataFrame) -> DataFrame:
    """Months to look into for each query without a period of its own: ``(query_id, month)``.

    ``matched(query_id, proposed_at, processed_at)``; ``queries(query_id, scope, history)``; ``ends(scope, day_to)``.
    The months of the dates of what matched and the last two up to today or the end of the query's term;
    where the whole history is asked for, every month from the earliest proposal on.
    """
    now = F.lit(today).cast("date")
    last = queries.join(F.broadcast(ends), "scope", "left").select("query_id", "history", F.least(now, F.coalesce("day_to", now)).alias("upto"))  # a handful of terms of office
    days = matched.join(last, "query_id").select("query_id", "upto", F.explode(F.array("proposed_at", "processed_at")).alias("day")).where(F.col("day") <= F.col("upto")).select("query_id", F.trunc("day", "MM").alias("month"))
    recent = last.select("query_id", F.explode(F.array(F.trunc("upto", "MM"), F.trunc(F.add_months("upto", -1), "MM"))).alias("month"))
    first = matched.groupBy("query_id").agg(F.min("proposed_at").alias("first")).join(last.where("history"), "query_id").where(F.col("first") <= F.col("upto"))
    filled = first.select("query_id", F.explode(F.sequence(F.trunc("first", "MM"), F.trunc("upto", "MM"), F.expr("interval 1 month"))).alias("month"))
    return days.unionByName(recent).unionByName(filled).distinct()


def content_terms(hits: DataFrame, wanted: DataFrame, least: int = 2) -> DataFrame:
    """``hits(query_id, ..., matched)`` with ``least`` of their query's ``wanted(query_id, wanted)`` terms, or all of a shorter query's; where none has, all stay."""
    marked = hits.join(wanted, "query_id").withColumn("good", F.col("matched") >= F.least(F.lit(least), F.col("wanted")))
    some = marked.groupBy("query_id").agg(F.bool_or("good").alias("some"))
    return marked.join(some, "query_id").where("good or not some").select(*hits.columns)
