"""Transcripts to speaker turns: lines, markers, running sums; no per-document code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BULLET = r"^\s*[○◯●]\s*\S"
COLON = r"^\s*[^\s:：][^:：]{0,38}[:：]\s*"
AGENDA = r"^\s*[0-9]+\.\s+\S"
#: Characters before the first marker beyond which their loss is a failure.
LONG_PREFIX = 80


def segment(pages: DataFrame, bullet: str = BULLET, colon: str = COLON, agenda: str = AGENDA) -> tuple[DataFrame, DataFrame]:
    """``pages(doc, page, text)`` to turns and failures.

    Colon markers count only in documents without a bullet.  A page's lines before its first marker
    go on with the last turn, unless an agenda heading stands between.  Turns carry the agenda that
    was last announced and the pages they span.  Turns: ``doc, turn, label, body, agenda, pages, start``
    (character offset of the marker line in its document).  Several headings between two speakers
    are announced jointly.  Failures: ``doc, turn, reason``; more than ``LONG_PREFIX`` characters before
    the first marker, without a heading, are one of turn 0.
    """
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    by_doc = Window.partitionBy("doc")
    ordered = by_doc.orderBy("page", "line")
    flagged = lines.withColumns({"is_bullet": F.col("content").rlike(bullet), "is_agenda": F.col("content").rlike(agenda)})
    flagged = flagged.withColumn("has_bullet", F.max("is_bullet").over(by_doc))
    marker = F.when(F.col("has_bullet"), F.col("is_bullet")).otherwise(F.col("content").rlike(colon) & ~F.col("is_agenda"))
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    placed = flagged.withColumn("marker", marker).withColumns(
        {
            "turn": F.sum(F.col("marker").cast("long")).over(running),
            "end": F.sum(F.char_length("content") + 1).over(running),
            "headings": F.sum(F.col("is_agenda").cast("int")).over(running),
        }
    )
    # after a heading nothing belongs to a turn until the next marker
    at_marker = F.max(F.when(F.col("marker"), F.col("headings"))).over(Window.partitionBy("doc", "turn"))
    own = placed.withColumn("seen", at_marker).where((F.col("turn") > 0) & (F.col("headings") == F.col("seen")))
    split = F.when(F.col("has_bullet"), F.regexp_replace("content", r"^\s*[○◯●]\s*", "")).otherwise(F.col("content"))
    label = F.when(F.col("has_bullet"), F.regexp_extract(split, r"^(\S+(?:\s\S+)?)", 1)).otherwise(F.trim(F.regexp_extract(split, r"^([^:：]*)[:：]", 1)))
    said = F.when(~F.col("marker"), F.col("content")).when(F.col("has_bullet"), F.regexp_replace(split, r"^\S+(?:\s\S+)?\s*", "")).otherwise(F.regexp_replace(split, r"^[^:：]*[:：]\s*", ""))
    parts = own.select("doc", "turn", F.when(F.col("marker"), label).alias("label"), (F.col("end") - F.char_length("content") - 1).alias("offset"), F.struct("page", "line", said.alias("said")).alias("part"))
    turns = parts.groupBy("doc", "turn").agg(
        F.max("label").alias("label"), F.array_sort(F.collect_list("part")).alias("parts"), F.min("offset").alias("start")
    )
    # headings since the marker before belong to the turn that follows
    heading = F.regexp_extract("content", r"^\s*([0-9]+)\.", 1)
    announced = placed.where("is_agenda").groupBy("doc", (F.col("turn") + 1).alias("turn")).agg(
        F.count("*").alias("n"), F.min_by(heading, F.struct("page", "line")).alias("first"), F.max_by(heading, F.struct("page", "line")).alias("last"), F.max_by(F.trim("content"), F.struct("page", "line")).alias("title")
    )
    told = F.when(F.col("n") == 1, F.col("title")).when(F.col("n") > 1, F.concat(F.lit("items "), "first", F.lit(".."), "last", F.lit(" jointly")))
    carried = F.last("told", ignorenulls=True).over(Window.partitionBy("doc").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    turns = turns.join(announced.select("doc", "turn", told.alias("told")), ["doc", "turn"], "left").withColumn("agenda", carried)
    body = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["said"]), "\n"), r"^\s+|\s+$", "")
    spanned = F.array_join(F.array_distinct(F.transform("parts", lambda p: p["page"].cast("string"))), "|")
    turns = turns.select("doc", "turn", "label", body.alias("body"), "agenda", spanned.alias("pages"), "start")
    reason = F.when(F.coalesce("label", F.lit("")) == "", "empty_label").when(F.col("body") == "", "empty_body")
    failures = turns.select("doc", "turn", reason.alias("reason")).where("reason is not null")
    prefix = placed.where("turn = 0").groupBy("doc").agg(F.sum(F.char_length(F.trim("content"))).alias("size"), F.max("is_agenda").alias("headed"))
    lost = prefix.where((F.col("size") > LONG_PREFIX) & ~F.col("headed")).select("doc", F.lit(0).cast("long").alias("turn"), F.lit("long_prefix").alias("reason"))
    return turns.where(reason.isNull()), failures.unionByName(lost)


def parse_quality(golden: DataFrame, parsed: DataFrame) -> DataFrame:
    """``golden(doc, turn, label)`` against ``parsed`` of the same columns, by position: precision, recall and f1 of each document.

    Turns of the parse may be numbered with gaps: their positions count.  ``duplicates`` are labels that
    the parse has more than once in a document.
    """
    position = F.row_number().over(Window.partitionBy("doc").orderBy("turn"))
    at = lambda df, name: df.select("doc", position.alias("position"), F.col("label").alias(name))
    both = at(golden, "want").join(at(parsed, "got"), ["doc", "position"], "full_outer")
    sums = both.groupBy("doc").agg(F.count("want").alias("expected"), F.count("got").alias("parsed"), F.count(F.when(F.col("want") == F.col("got"), 1)).alias("correct"), (F.count("got") - F.count_distinct("got")).alias("duplicates"))
    share = lambda n: F.round(F.coalesce(F.try_divide(F.col("correct"), F.col(n)), F.lit(0.0)), 6)
    f1 = F.round(F.coalesce(F.try_divide(2 * F.col("correct"), F.col("expected") + F.col("parsed")), F.lit(0.0)), 6)
    return sums.select("doc", "expected", "parsed", "correct", "duplicates", share("parsed").alias("precision"), share("expected").alias("recall"), f1.alias("f1"))
