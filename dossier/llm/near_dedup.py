"""Operator 9: SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints at 3 or fewer differing bits agree in at least 5 of their 8 bytes.  A
single positional byte is shared by one fingerprint in 256, so posting lists of single bytes
would be tallied for nearly every pair.  The lists are therefore keyed by three positional bytes
at once: of the two halves of four positions, five agreeing positions put three in one half, so
the eight triples within a half lose no pair.  Inside a posting list a pair's agreeing bytes are
counted, pairs below 5 are dropped, and the rest verified by their differing bits.

Equal fingerprints are one entry of the index.  Within a list, links are found by growing one
class at a time against the entries not reached yet, so a list of close entries costs about its
length, and only the links of a spanning forest leave it.  Lists longer than a block are dealt
to pairs of blocks, so no list has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.components import connected_components
from dossier.llm.shared import fresh, written

BITS = 3
SEED = 42
SHINGLE = 3
#: Entries of a posting list that one task compares; longer lists go to pairs of blocks.
BLOCK = 32_768
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
LEAST_BYTES = 8 - BITS


def text_fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash; a bit is 1 if over half of the shingle hashes have it; no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(words) >= shingle else [words]
        hashes = np.fromiter((xxh64_intdigest(b" ".join(g), seed) for g in grams), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """SimHash of a text column as a signed long (its bits)."""

    @F.arrow_udf("long")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.array([text_fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64)
            yield pa.array(found.view(np.int64))

    return udf(text)


def _agree(one: np.uint64, many: np.ndarray) -> np.ndarray:
    """Which of ``many`` link to ``one``: first the tally of equal bytes, then the differing bits."""
    differ = many ^ one
    folded = differ | (differ >> np.uint64(4))
    folded |= folded >> np.uint64(2)
    folded |= folded >> np.uint64(1)
    unequal = np.bitwise_count(folded & np.uint64(0x0101010101010101))
    found = np.flatnonzero(unequal <= 8 - LEAST_BYTES)
    return found[np.bitwise_count(differ[found]) <= BITS]


def forest(entries: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the distinct entries of a posting list, as entry numbers."""
    left, right = [], []
    rest = np.arange(len(entries))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            found = _agree(entries[at], entries[rest])
            if len(found):
                hit = rest[found]
                rest = np.delete(rest, found)
                queue += hit.tolist()
                left += [at] * len(hit)
                right += hit.tolist()
    return left, right


def links(fingerprints: DataFrame, block: int = BLOCK) -> DataFrame:
    """``fingerprints(fp long)``, distinct, to links ``(a, b)`` that connect whatever is within 3 bits.

    Not every link between close entries is returned, but their classes are the same.
    """
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(0xFF) for p in range(8)]
    keys = [F.lit(k << 24).cast("long").bitwiseOR(F.shiftleft(byte[a], 16)).bitwiseOR(F.shiftleft(byte[b], 8)).bitwiseOR(byte[c]) for k, (a, b, c) in enumerate(TRIPLES)]
    postings = fingerprints.select("fp", F.explode(F.array(*keys)).alias("key"))
    long = written(postings.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("blocks")), "long-lists")
    parts = [postings.withColumn("pair", F.lit(0).cast("long"))]
    if long.take(1):
        # at most fingerprints * 8 / block keys are long; Spark broadcasts them if they are few
        parts[0] = parts[0].join(long, "key", "left_anti")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        dealt = postings.join(long, "key").withColumn("own", own).withColumn("other", other)
        pair = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1
        parts.append(dealt.select("fp", "key", pair.alias("pair")))
    dealt = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    dealt = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(fp: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for s, e in zip(starts.tolist(), ends.tolist()):
                left, right = forest(fp[s:e])
                a.append(fp[s:e][left])
                b.append(fp[s:e][right])
            both = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["a", "b"])

        kept: list[np.ndarray] = []  # the last list may go on in the next batch
        for batch in batches:
            kept.append(np.stack([batch.column(i).to_numpy() for i in range(3)]))
            rows = np.concatenate(kept, axis=1)
            edge = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            if not len(edge):
                kept = [rows]
                continue
            starts, ends = np.append(0, edge[:-1]), edge
            many = ends - starts > 1
            yield found(rows[2].view(np.uint64), ends[many], starts[many])
            kept = [rows[:, edge[-1] :]]
        if kept:
            rows = np.concatenate(kept, axis=1)
            yield found(rows[2].view(np.uint64), np.array([rows.shape[1]]), np.array([0]))

    return dealt.select("key", "pair", "fp").mapInArrow(compare, "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, fp)`` of every row, and ``(fp, root, doc_id)``: each fingerprint's class and smallest id."""
    own = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col).cast("string")).alias("fp")), "fingerprints")
    by_fp = written(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct-fingerprints")
    roots = connected_components(links(by_fp.select("fp"), block)).select(F.col("node").alias("fp"), "root")
    return own, by_fp.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: its SimHash and the smallest id it is linked to.

    Rows with 3 or fewer differing bits are linked, and classes are what links reach.  Null and
    empty texts have fingerprint 0 and are linked like any other.  Repeated rows and ids come back
    as often as they came in.  A null id is never a class's smallest, unless all are null.  An empty
    table gives no rows; other columns are not read.
    """
    own, rooted = _classes(docs, id_col, text_col, block)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, and of its rows the one with the least
    fingerprint and text; with all its columns, whatever their names.

    A row is known by its id and its fingerprint, so a unique text stays though another row has its id.
    Rows without an id cannot be told apart and stay.
    """
    own, rooted = _classes(docs, id_col, text_col, block)
    key, print_, order = (fresh(docs, f"kept_{name}") for name in ("id", "print", "order"))
    least = rooted.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("kept"))
    kept = written(least.select(F.col("kept.doc_id").alias(key), F.col("kept.fp").alias(print_)), "kept")
    shared = own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key))
    shared = written(shared, "shared-ids")  # ids of several rows; only these need their fingerprint again
    rows = docs.where(F.col(id_col).isNotNull()).join(kept.join(shared, key, "left_anti").select(key), F.col(id_col) == F.col(key)).drop(key)
    out = rows.unionByName(docs.where(F.col(id_col).isNull()))
    if shared.take(1):
        several = docs.join(kept.select(key).join(shared, key).distinct(), F.col(id_col) == F.col(key)).drop(key)
        several = several.withColumn(print_, fingerprint(F.col(text_col).cast("string")))
        wanted = kept.withColumnRenamed(print_, order).join(shared, key)
        several = several.join(wanted, (F.col(id_col) == F.col(key)) & (F.col(print_) == F.col(order))).drop(key, order)
        first = F.row_number().over(Window.partitionBy(id_col, print_).orderBy(text_col))
        out = out.unionByName(several.withColumn(order, first).where(F.col(order) == 1).drop(order, print_))
    return out
