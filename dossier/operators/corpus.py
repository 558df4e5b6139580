"""Corpus lifecycle: differences, upserts, inventories, outcomes, coverage, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revision_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Each identity of two revisions as added, changed, removed or same."""
    o, n = old.select(key, F.col(digest).alias("o"), F.lit(True).alias("in_old")), new.select(key, F.col(digest).alias("n"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row that changes iff the rows do, whatever their order: count, xor and sum over row digests."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)), 256), 1, 15), 16, 10).cast("long")
    return df.select(digest.alias("d")).agg(F.count("*").alias("n_rows"), F.bit_xor("d").alias("xored"), F.sum(F.col("d") % 1_000_003).alias("summed"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``; all columns."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All columns of a key replaced by the row of the highest version; last write wins."""
    both = base.withColumn("_from", F.lit(0)).unionByName(incoming.withColumn("_from", F.lit(1)))
    return latest(both, keys, [F.desc(version), F.desc("_from")]).drop("_from")


def replace_groups(base: DataFrame, incoming: DataFrame, group: str) -> DataFrame:
    """Every row of the groups that ``incoming`` has is replaced by its rows."""
    return base.join(incoming.select(group).distinct(), group, "left_anti").unionByName(incoming)


def scope_coverage(expected: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Accounting of each scope; an unknown (null) expectation stays unknown and is never complete."""
    done = outcomes.groupBy(*keys).agg(F.count(F.when(F.col("ok"), 1)).alias("succeeded"), F.count(F.when(~F.col("ok"), 1)).alias("failed"))
    joined = expected.join(done, keys, "left").fillna(0, ["succeeded", "failed"])
    left = F.col("expected") - F.col("succeeded") - F.col("failed")
    complete = F.coalesce((left == 0) & (F.col("failed") == 0), F.lit(False))
    return joined.withColumns({"unaccounted": left, "complete": complete, "over_accounted": F.coalesce(left < 0, F.lit(False))})


def verify(stored: DataFrame, manifest: DataFrame, key: str, text: str, digest: str) -> DataFrame:
    """Keys of the ``manifest(key, digest)`` whose stored text is missing or has another hash."""
    joined = manifest.select(key, digest).join(stored.select(key, F.sha2(text, 256).alias("found")), key, "left")
    fault = F.when(F.col("found").isNull(), "missing").when(~F.col("found").eqNullSafe(F.col(digest)), "tampered")
    return joined.select(key, fault.alias("fault")).where("fault is not null")


def merge_checkpoint(prior: DataFrame, current: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Prior outcomes of work items that are the same now: equal in the key and, nulls alike, in all columns ``same``.

    ``same`` are the item's hash, inventory, parser and parent: with another of these the work has to be done again.
    """
    now = current.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in same)).distinct()
    on = F.col(key) == F.col("_key")
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return prior.join(now, on, "left_semi")


def work_inventory(bills: DataFrame, originals: DataFrame, reviews: DataFrame, meetings: DataFrame, day_from: str, day_to: str) -> tuple[DataFrame, DataFrame]:
    """Expected work ``(term, kind, item)`` and gaps ``(term, kind, item, gap)``.

    One original for each of ``bills(number, term)`` among ``originals(number)`` (none and several are gaps);
    each address of ``reviews(number, url)`` whose bill is known, once; each meeting of ``meetings(url, term,
    held_on)`` with a date within the range, those without a date are gaps, others no work.
    """
    per = originals.groupBy("number").agg(F.count("*").alias("n"))
    gap = F.when(F.col("n").isNull(), "missing_original").when(F.col("n") > 1, "several_originals")
    own = bills.join(per, "number", "left").select("term", F.lit("original").alias("kind"), F.col("number").alias("item"), gap.alias("gap"))
    of = reviews.select("number", "url").distinct().join(bills.select("number", "term"), "number", "left")
    twice = F.count("*").over(Window.partitionBy("url"))
    listed = of.withColumn("n", twice).select("term", F.lit("review").alias("kind"), F.col("url").alias("item"), F.when(F.col("term").isNull(), "unknown_bill").when(F.col("n") > 1, "shared_url").alias("gap"))
    day = F.col("held_on")
    dated = meetings.where(day.isNull() | day.between(F.lit(day_from).cast("date"), F.lit(day_to).cast("date")))
    minutes = dated.select("term", F.lit("minutes").alias("kind"), F.col("url").alias("item"), F.when(day.isNull(), "missing_date").alias("gap"))
    every = own.unionByName(listed).unionByName(minutes)
    return every.where("gap is null").drop("gap"), every.where("gap is not null")


def expected_work(items: DataFrame, gaps: DataFrame, whole: DataFrame) -> DataFrame:
    """Per (term, kind) the items and gaps, and what is expected: null where ``whole(term, complete)`` does not say that its metadata is complete."""
    by = lambda df, name: df.groupBy("term", "kind").agg(F.count("*").alias(name))
    both = by(items, "items").join(by(gaps, "gaps"), ["term", "kind"], "full_outer").fillna(0, ["items", "gaps"])
    known = whole.where("complete").select("term", F.lit(True).alias("known"))
    return both.join(known, "term", "left").select("term", "kind", "items", "gaps", F.when(F.col("known"), F.col("items")).alias("expected"))
