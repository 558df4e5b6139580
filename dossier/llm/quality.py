"""Operator 8: importance resampling of good text.

Two hashed n-gram models (words and word pairs, add-one smoothed) are counted: of all documents
and of the target, the documents labelled good.  A document's weight is the log ratio of what the
two models give its n-grams.  A Gumbel number drawn from the hash of its id is added, and the k
largest sums are a sample without replacement in proportion to the weights.

Counting and scoring are narrow passes in numpy; what crosses the network is one vector of counts
a partition.  The k-th largest sum is found by radix selection: four grouped counts over 16 bits
of the scaled sum each, so no task orders all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.decontamination import words_of
from dossier.llm.shared import fresh, written

BUCKETS = 10_000
#: Most labelled documents that make up the target; the hash of the id picks them.
TARGET = 20_000
SLICE_BYTES = 2 << 20


def ngram_buckets(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of the texts, text by text, and where each text's begin."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin = np.cumsum([0] + [len(r) + 1 for r in raw])
    starts, hashes = words_of(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
    bounds = np.searchsorted(starts, begin)
    with np.errstate(over="ignore"):
        pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[1:] if len(hashes) else hashes
        single, pairs = _spread(hashes, buckets), _spread(pairs * np.uint64(0xC2B2AE3D27D4EB4F), buckets)
    own = np.repeat(np.arange(len(texts)), np.diff(bounds))
    within = own[1:] == own[:-1] if len(own) else np.zeros(0, bool)
    owner = np.concatenate([own, own[:-1][within]]) if len(own) else own
    flat = np.concatenate([single, pairs[within]]) if len(own) else single
    order = np.argsort(owner, kind="stable")
    return flat[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _spread(h: np.ndarray, buckets: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    at, part, held = 0, [], 0
    for text in batch.column(column):
        part.append(text.as_py())
        held += len(part[-1] or "")
        if held >= SLICE_BYTES:
            yield at, part
            at, part, held = at + len(part), [], 0
    if part:
        yield at, part


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, target: int = TARGET) -> np.ndarray:
    """Log ratio of target and raw model for every bucket, from all documents.

    The target is at most ``target`` documents with label 1, picked by the hash of their id.
    """
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("good")).distinct()
    chosen = F.broadcast(good.orderBy(F.xxhash64("good"), "good").limit(target))  # ``target`` numbers at most
    frame = docs.select(F.col(id_col).alias("good"), F.col(text_col).cast("string").alias("text"))
    marked = frame.join(chosen.withColumn("is_target", F.lit(True)), "good", "left").select("is_target", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, buckets), np.int64)
        for batch in batches:
            flags = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for at, texts in _slices(batch, 1):
                flat, bounds = ngram_buckets(texts, buckets)
                both[0] += np.bincount(flat, minlength=buckets)
                own = np.repeat(flags[at : at + len(texts)], np.diff(bounds))
                both[1] += np.bincount(flat[own], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(both[0]), pa.array(both[1])], names=["bucket", "raw", "target"])

    counts = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, aim = np.ones(buckets), np.ones(buckets)
    for r in counts.collect():  # ``buckets`` rows
        raw[r.bucket] += r.raw
        aim[r.bucket] += r.target
    return np.log(aim / aim.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 8) -> DataFrame:
    """``(doc_id, n_grams, log_weight, noisy)`` for every row; ``noisy`` has the Gumbel number added."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = held.value
        for batch in batches:
            sums, sizes = [], []
            for _, texts in _slices(batch, 1):
                flat, bounds = ngram_buckets(texts, len(ratio))
                value = np.append(ratio[flat], 0.0)
                size = np.diff(bounds)
                sums.append(np.where(size > 0, np.add.reduceat(value, bounds[:-1]), 0.0))
                sizes.append(size)
            columns = [batch.column(0), pa.array(np.concatenate(sizes or [np.zeros(0, np.int64)])), pa.array(np.concatenate(sums or [np.zeros(0)]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_grams", "log_weight"])

    scored = frame.mapInArrow(score, f"doc_id {kind}, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    return scored.withColumn("noisy", F.col("log_weight") - F.log(-F.log(uniform)))


def _threshold(rows: DataFrame, value: Column, left: int) -> tuple[int, int]:
    """The ``left``-th largest of the longs ``value`` (not negative), and how many of its equals are among the ``left`` largest.

    Radix selection: grouped counts of 16 bits at a time, 65536 rows at most each.
    """
    prefix = 0
    for shift in (48, 32, 16, 0):
        inside = rows if shift == 48 else rows.where(F.shiftrightunsigned(value, shift + 16) == prefix)
        counts = inside.groupBy(F.shiftrightunsigned(value, shift).bitwiseAND(0xFFFF).alias("part")).count().collect()
        for part, n in sorted(((r.part, r["count"]) for r in counts), reverse=True):
            if n >= left:
                prefix = prefix << 16 | part
                break
            left -= n
    return prefix, left


def select_largest(scored: DataFrame, k: int, by: str = "noisy", tie: str = "doc_id") -> DataFrame:
    """``scored`` with ``selected``: true for the k rows with the largest ``by``, ties by the smaller ``tie``.

    ``by`` is a double, ``tie`` a long.  Three keys decide one after the other, each by radix selection: the
    sum in steps of a 2 ** -62nd of the largest, the tie, and for rows alike in both the row's place in
    the table, so no task orders rows.  A null ``tie`` comes after all others, a null or NaN ``by`` last.  ``scored`` has to
    be a table that is read again in the same order, as one written before is.  A column ``selected``
    is replaced; all others stay.
    """
    names = [c for c in scored.columns if c.lower() != "selected"]
    size, place = fresh(scored, "key_of_size"), fresh(scored, "key_of_place")
    n, most = scored.agg(F.count("*"), F.max(F.abs(F.when(~F.isnan(by), F.col(by))))).first()
    if k <= 0 or k >= n:
        return scored.select(*names, F.lit(k > 0).alias("selected"))
    unit = 2.0 ** (61 - max(-900, math.frexp(most or 1.0)[1]))
    whole = F.floor(F.col(by) * F.lit(unit)).cast("long") + F.lit(1 << 61)
    rows = scored.select(*names, F.monotonically_increasing_id().alias(place)).withColumn(size, F.when(F.col(by).isNull() | F.isnan(by), 0).otherwise(whole + 1))
    after = F.bitwise_not(F.col(tie).cast("long").bitwiseXOR(F.lit(-(1 << 63))))  # as unsigned, larger for smaller ties
    halves = [F.coalesce(F.shiftrightunsigned(after, 32) + 1, F.lit(0)), F.coalesce(after.bitwiseAND(0xFFFFFFFF), F.lit(0))]
    keys = [F.col(size), *halves, F.lit((1 << 62) - 1) - F.col(place)]
    inside, selected = F.lit(True), F.lit(False)
    for key in keys:
        least, k = _threshold(rows.where(inside), key, k)
        selected = selected | (inside & (key > least))
        inside = inside & (key == least)
    return rows.select(*names, (selected | inside).alias("selected"))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float | None = None, seed: int = 8) -> DataFrame:
    """``(doc_id, n_grams, log_weight, noisy, selected)`` for every row.

    ``share`` of the rows is selected; by default the share of label 1 among the labels, or all
    without labels.  Null and empty texts have weight 0; repeated ids get the same noise; null ids
    are drawn alike; ties go to the smaller id; an empty table gives no rows; other columns are not
    read, whatever their names.  Very long texts are counted and weighed whole.
    """
    scored = written(weigh(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col, seed), "quality-scores")
    if share is None:
        mean = labels.where(F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0]
        share = 1.0 if mean is None else float(mean)
    return select_largest(scored, round(share * scored.count()))
