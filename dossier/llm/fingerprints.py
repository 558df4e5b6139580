"""Operator 2: order MinHash of documents.

A k-mer is 16 characters from a word's start on, and in runs of characters without white space from
every character on that has 16 such before it, so texts without spaces have their k-mers too and
an edit changes only those around it.  Equal k-mers are numbered by occurrence.  Each of 32 slots has
a permutation of its own of the (k-mer, occurrence) pairs and one bit of it that splits them in two;
the least pair of each half is selected, the two are put in the order they have in the text, and
their tuple is hashed.  Moved passages change that order where a set of k-mers would not notice.

Only DataFrame functions.  A document's k-mers become rows for as long as the map side of one
aggregation takes, which keeps 64 running minima a document in generated code; what is shuffled is
those minima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.shared import bind, fresh

K = 16
#: A match takes a word's first 16 characters or, further on in a word, one; its k-mer is looked ahead for.
KMER = rf"(?s)(?=(\S.{{0,{K - 1}}}))(?:(?<!\S)\S{{1,{K}}}|(?<=\S)\S)"
SLOTS = 32
POSITION = (1 << 28) - 1
WIDTH = 8  # hex digits of a slot
EMPTY = "-" * WIDTH


def _packed(value: Column, position: Column) -> Column:
    return F.shiftleft(value, 28).bitwiseOR(position.cast("long"))


def kmers(text: Column) -> Column:
    """The k-mers of a text as array of (hash of k-mer and occurrence number, position), in no order."""

    def numbered(hashes: Column) -> Column:
        """Where k-mers repeat: sorted, so that equal ones are neighbours with ascending positions."""
        head = lambda a, i: F.shiftrightunsigned(F.get(a, i), 28)

        def runs(packed: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(packed) - 1), lambda i: (i == 0) | (head(packed, i) != F.coalesce(head(packed, i - 1), F.lit(-1))))

            def one(starts: Column) -> Column:
                pair = lambda i, first: F.struct(F.xxhash64(head(packed, i), i - first).alias("hash"), F.get(packed, i).bitwiseAND(POSITION).cast("int").alias("at"))
                run = lambda first, r: F.transform(F.sequence(first, F.coalesce(F.get(starts, r + 1), F.size(packed)) - 1), lambda i: pair(i, first))
                return F.flatten(F.transform(starts, run))

            return bind(starts, one)

        return bind(F.sort_array(F.transform(hashes, _packed)), runs)

    low = lambda h: F.shiftrightunsigned(F.shiftleft(h, 28), 28)
    alone = lambda hashes: F.transform(hashes, lambda h, i: F.struct(F.xxhash64(h, F.lit(0)).alias("hash"), i.alias("at")))
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(KMER), F.lit(1)), lambda k: low(F.xxhash64(k)))
    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), alone(h)).otherwise(numbered(h)))


def _slots(hash: Column, at: Column) -> list[Column]:
    """The running minima of all slots: 36 bits of the permuted hash above the position, for each half."""
    out = []
    for slot in range(SLOTS):
        permuted = F.xxhash64(hash, F.lit(slot))
        value = F.shiftleft(F.shiftrightunsigned(permuted, 29), 28).bitwiseOR(at.cast("long"))
        for half in (0, 1):
            out.append(F.min(F.when((permuted < 0) == F.lit(bool(half)), value)).alias(f"slot_{slot}_{half}"))
    return out


def _signature() -> Column:
    """32 times 8 hex digits from the minima; a slot without k-mers is dashes, no k-mers at all give ''."""
    digits = []
    for slot in range(SLOTS):
        low, high = F.col(f"slot_{slot}_0"), F.col(f"slot_{slot}_1")
        place, what = lambda x: x.bitwiseAND(POSITION), lambda x: F.shiftrightunsigned(x, 28)
        one, two = F.when(place(low) <= place(high), what(low)).when(high.isNull(), what(low)).otherwise(what(high)), F.when(place(low) <= place(high), what(high)).when(high.isNull(), None).otherwise(what(low))
        hashed = F.lower(F.right(F.lpad(F.hex(F.xxhash64(one, two)), 16, "0"), F.lit(WIDTH)))
        digits.append(F.when(low.isNull() & high.isNull(), EMPTY).otherwise(hashed))
    return F.when(F.coalesce(*(F.col(f"slot_0_{h}") for h in (0, 1))).isNull(), "").otherwise(F.concat(*digits))


def order_min_hash(rows: DataFrame, text: str, into: str, known_by: list[str] | None = None) -> DataFrame:
    """``rows`` with the column ``text`` replaced by its signature ``into``; all other columns are kept.

    The signature is 32 times 8 hex digits, equal for equal texts; texts of white space alone, empty
    and null texts give ''.  Columns ``known_by`` that tell rows apart save numbering them, and where rows
    already lie together by one of these, nothing is shuffled.
    """
    if into.lower() in {c.lower() for c in rows.columns if c != text}:
        raise ValueError(f"there is a column {into} already")
    kept = [c for c in rows.columns if c != text]
    keys = kept
    if known_by is None:
        rows, keys = rows.withColumn(number := fresh(rows, "row_number"), F.monotonically_increasing_id()), [number, *kept]
    found = rows.select(*keys, F.explode_outer(kmers(F.col(text))).alias(text))
    least = found.groupBy(*keys).agg(*_slots(F.col(f"{text}.hash"), F.col(f"{text}.at")))
    return least.select(*kept, _signature().alias(into))


def likeness(one: Column, other: Column) -> Column:
    """Share of equal slots among those that either text fills, 0 to 1; two texts without k-mers: 1."""
    part = lambda s, b: F.substring(s, b * WIDTH + 1, WIDTH)
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    filled = F.size(F.filter(slots, lambda b: (part(one, b) != EMPTY) | (part(other, b) != EMPTY)))
    equal = F.size(F.filter(slots, lambda b: (part(one, b) == part(other, b)) & (part(one, b) != EMPTY)))
    return F.when((one == "") & (other == ""), 1.0).when((one == "") | (other == ""), 0.0).otherwise(equal / filled)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` for every row.

    Null and empty texts have the fingerprint ''; null and repeated ids and repeated rows stay; an empty
    table gives no rows; other columns are not read, whatever their names.  Very long texts take time
    in proportion to their length.
    """
    return order_min_hash(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", "fingerprint")


def _rank_in(values: list[int], x: Column) -> Column:
    """How many of the ascending ``values`` are at most x, by halving; null: 0."""
    if not values:
        return F.lit(0)
    listed, steps = F.lit(values), [1 << k for k in reversed(range(len(values).bit_length()))]
    step = lambda at, p: F.when((at + p <= len(values)) & (F.get(listed, at + p - 1) <= x), at + p).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def deal(rows: DataFrame, id_col: str = "doc_id", tie_col: str = "text", buckets: int | None = None, names: tuple[str, str, str] = ("bucket", "guard", "place")) -> DataFrame:
    """``rows`` dealt to buckets by ranges of ``id_col`` (an integer), with three more columns of these ``names``.

    ``place`` numbers a bucket's rows in ascending id, null ids first, equal ids by the hash of ``tie_col``.
    The first row of a bucket is also sent to the bucket before it (the very first one to the last), as
    a ``guard`` after all others, so that whatever follows a row is in its bucket; who needs a row once
    leaves the guards out in the end.  Bounds are percentiles of the id, and what is broadcast are
    two numbers a bucket.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    if buckets is None:
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    to, guard, place = names
    tie, at_bucket, where = (fresh(rows, f"{name}_of_row") for name in ("tie", "bucket", "deal"))
    keyed = rows.withColumn(tie, F.xxhash64(tie_col))
    shares = [k / buckets for k in range(1, buckets)] or [0.5]
    bounds = keyed.agg(F.percentile_approx(id_col, F.lit(shares), F.lit(max(1000, 10 * buckets)))).first()[0] or []
    bounds = sorted(set(bounds)) if buckets > 1 else []
    bucket = _rank_in(bounds, F.col(id_col)).cast("int")
    found = keyed.select(bucket.alias("bucket"), F.struct(F.col(id_col).alias("id"), F.col(tie).alias("tie")).alias("row")).groupBy("bucket").agg(F.min("row").alias("first")).collect()
    firsts = {r.bucket: r.first for r in found}
    order = sorted(firsts)
    ids, ties, before = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for k, b in enumerate(order):
        ids[b], ties[b], before[b] = firsts[b].id, firsts[b].tie, order[k - 1]
    at = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col(at_bucket))
    is_first = F.col(id_col).eqNullSafe(at(ids, "long")) & (F.col(tie) == at(ties, "long"))
    own = F.struct(F.col(at_bucket).alias("to"), F.lit(False).alias("guard"))
    extra = F.struct(at(before, "int").alias("to"), F.lit(True).alias("guard"))
    dealt = keyed.withColumn(at_bucket, bucket).withColumn(where, F.explode(F.when(is_first, F.array(own, extra)).otherwise(F.array(own))))
    dealt = dealt.select(*rows.columns, tie, F.col(f"{where}.to").alias(to), F.col(f"{where}.guard").alias(guard))
    number = F.row_number().over(Window.partitionBy(to).orderBy(guard, F.col(id_col).asc_nulls_first(), tie))
    return dealt.withColumn(place, number).drop(tie)


def following(dealt: DataFrame, carry: list[str], names: tuple[str, str, str] = ("bucket", "guard", "place")) -> DataFrame:
    """``dealt`` rows with ``next_<c>`` of the following row for each c of ``carry``; guards have none."""
    window = Window.partitionBy(names[0]).orderBy(names[2])
    return dealt.select("*", *(F.lead(c).over(window).alias(f"next_{c}") for c in carry))


def with_next(rows: DataFrame, carry: list[str], id_col: str = "doc_id", tie_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``rows`` with ``next_<c>`` of the row that follows by ``id_col`` for each c of ``carry``; after the last the first.

    The order is that of ``deal``.  All columns of ``rows`` stay as they are, whatever their names;
    ``next_<c>`` must be new.  An empty table gives no rows.
    """
    if clash := {f"next_{c}".lower() for c in carry} & {c.lower() for c in rows.columns}:
        raise ValueError(f"there are columns {sorted(clash)} already")
    names = tuple(fresh(rows, f"{n}_dealt") for n in ("bucket", "guard", "place"))
    return following(deal(rows, id_col, tie_col, buckets, names), carry, names).where(~F.col(names[1])).drop(*names)


def edited_text() -> Column:
    """The last quarter of ``text`` replaced by as many code points from the start of ``next_text``."""
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    return F.concat(F.substring("text", F.lit(1), F.char_length("text") - quarter), F.substring("next_text", F.lit(1), quarter))
