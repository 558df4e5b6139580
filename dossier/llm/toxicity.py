"""Operator 7: toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams (with word edges); its vector is their mean,
a document's vector the mean over its words, each weighted by the root of its count, with some
neutral words added; a softmax over that gives the score.  Table and
softmax are trained together, in numpy, on a bounded sample of labelled documents.  A misspelt
word shares most of its n-grams with the word it comes from, so it needs no vector of its own.

Averages are linear: once trained, every n-gram has one number, a word the mean of its n-grams'
numbers, and a document the mean of its words'.  Workers keep the numbers of words seen before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.shared import written

#: Most labelled documents of either label that a fit collects, and most bytes of their word counts; in the order
#: of the hash of the id, a document that would exceed the bytes is passed over.
SAMPLE = 2000
SAMPLE_BYTES = 24 << 20
BUCKETS = 1 << 16
SIZE = 4
EPOCHS = 12
THRESHOLD = 0.3
#: Neutral words added to every document: a few words alone prove little.
PRIOR_WORDS = 30
CACHE_WORDS = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subwords(vocabulary: list[str], buckets: int = BUCKETS, shortest: int = 3, longest: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every word (with its edges) and of the words themselves, word by word.

    Returns the buckets and where each word's begin.  Hashes are taken over code points, all words
    at once.
    """
    marked = [f"<{w}>" for w in vocabulary]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(m) for m in marked])
    ends = np.cumsum(sizes)
    end_of = np.repeat(ends, sizes)
    word = np.repeat(np.arange(len(marked)), sizes)
    owner, found = [], []
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(points * (points + np.uint64(0x9E37)) * _PRIME ** (np.arange(len(points)) - (ends - sizes)[word] + 1).astype(np.uint64)))
        whole = sums[ends] - sums[ends - sizes]
        value = np.zeros(len(points), np.uint64)
        for n in range(1, longest + 1):
            at = np.arange(len(points) - n + 1)
            value = (value[: len(at)] ^ points[n - 1 :]) * _PRIME
            if n >= shortest:
                inside = at + n <= end_of[at]
                owner.append(word[at[inside]])
                found.append(value[inside] + np.uint64(n))
        owner.append(np.arange(len(marked)))
        found.append(whole)
        mixed = np.concatenate(found)
        mixed ^= mixed >> np.uint64(31)
        mixed *= _PRIME
        bucket = ((mixed >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(marked)))


class Model:
    """``number``: each bucket's contribution to the log odds; ``bias``: log odds of no words."""

    def __init__(self, number: np.ndarray, bias: float):
        self.number, self.bias = number, bias
        self.known: dict[str, float] = {}

    def learn(self, new: list[str]) -> None:
        if new:
            flat, first = subwords(new, len(self.number))
            means = np.add.reduceat(self.number[flat], first) / np.diff(np.append(first, len(flat)))
            self.known.update(zip(new, means.tolist()))

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for at in range(0, len(texts), 256):
            found = [Counter(words(t)) for t in texts[at : at + 256]]
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            self.learn(list({w for ws in found for w in ws}.difference(self.known)))
            number = self.known.__getitem__
            for bag in found:
                weights = [sqrt(n) for n in bag.values()]
                out.append(self.bias + sum(map(mul, map(number, bag), weights)) / (sum(weights) + PRIOR_WORDS))
        return (1 / (1 + np.exp(-np.clip(out, -30, 30)))).tolist()


def _batch(rows: list[tuple[np.ndarray, np.ndarray]], flat: np.ndarray, bounds: np.ndarray) -> tuple:
    """What every pass over a batch of documents needs of its words and their n-grams."""
    at = np.concatenate([r[0] for r in rows])
    share = np.concatenate([r[1] for r in rows])[:, None]
    begin = np.cumsum([0] + [len(r[0]) for r in rows[:-1]])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, place = np.unique(at, return_inverse=True)
    width = bounds[used + 1] - bounds[used]
    spans = flat[np.repeat(bounds[used], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)]
    by_word = np.argsort(place, kind="stable").astype(np.int32)
    by_gram = np.argsort(spans, kind="stable").astype(np.int32)
    grams, first = np.unique(spans[by_gram], return_index=True)
    return (
        spans, np.cumsum(width) - width, width[:, None], place.astype(np.int32), share, begin, owner.astype(np.int32), by_word,
        np.searchsorted(place[by_word], np.arange(len(used))), np.repeat(np.arange(len(used), dtype=np.int32), width)[by_gram], grams, first,
    )


def _all_subwords(vocabulary: list[str], buckets: int, block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, word by word, and their bounds, worked out a block of words at a time."""
    parts, sizes = [], []
    for at in range(0, len(vocabulary), block):
        flat, first = subwords(vocabulary[at : at + block], buckets)
        parts.append(flat)
        sizes.append(np.diff(np.append(first, len(flat))))
    return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))


def counted(text: str | None) -> str:
    """A text's distinct words with their counts, space-joined."""
    return " ".join(f"{w} {n}" for w, n in Counter(words(text)).items())


def train(bags: list[str], labels: list[int], rate: float, buckets: int = BUCKETS, size: int = SIZE, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit n-gram table and softmax together, by Adagrad over batches of documents (as ``counted`` gives them).

    ``rate`` is the natural share of label 1; the bias is moved from the sample's share to it.
    """
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    if not any(labels) or all(labels):
        return Model(np.zeros(buckets), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    rows = []
    for bag in bags:  # one document's words at a time: a list of all would be the driver's largest object
        listed = bag.split() or ["", "0"]
        ids, counts = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in listed[::2]]), np.array(listed[1::2], np.float64)
        weights = np.sqrt(counts)
        rows.append((ids.astype(np.int32), (weights / (weights.sum() + PRIOR_WORDS)).astype(np.float32)))
    flat, bounds = _all_subwords(list(vocabulary), buckets)
    del vocabulary
    order = rng.permutation(len(bags))
    batches = [(d, _batch([rows[i] for i in d], flat, bounds)) for d in np.array_split(order, max(1, len(order) // 64))]
    table = rng.uniform(-1, 1, (buckets, size)) / size
    soft, bias = rng.normal(0, 0.1, (size, 2)), np.zeros(2)
    seen_table, seen_soft, seen_bias = np.full(buckets, 1e-8), np.full((size, 2), 1e-8), np.full(2, 1e-8)
    target = np.array(labels)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            docs_at, (spans, begin, width, place, share, doc_begin, owner, by_word, word_first, gram_word, grams, gram_first) = batches[k]
            vectors = np.add.reduceat(table[spans], begin) / width
            docs = np.add.reduceat(vectors[place] * share, doc_begin) * SCALE
            logits = docs @ soft + bias
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(docs)), target[docs_at]] -= 1
            error /= len(docs)
            g_soft, g_bias, g_docs = docs.T @ error, error.sum(axis=0), error @ soft.T * SCALE
            g_words = np.add.reduceat((g_docs[owner] * share)[by_word], word_first) / width
            g_table = np.add.reduceat(g_words[gram_word], gram_first)
            seen_table[grams] += (g_table**2).mean(axis=1)
            table[grams] -= RATE * g_table / np.sqrt(seen_table[grams])[:, None]
            seen_soft += g_soft**2
            soft -= RATE * g_soft / np.sqrt(seen_soft)
            seen_bias += g_bias**2
            bias -= RATE * g_bias / np.sqrt(seen_bias)
    own = np.mean(labels)
    shift = np.log(rate / (1 - rate)) - np.log(own / (1 - own))
    return Model(table @ (soft[:, 1] - soft[:, 0]) * SCALE, float(bias[1] - bias[0] + shift))


RATE = 0.1  # of Adagrad
#: A document's mean vector is scaled by this before the softmax, so that one word in hundreds counts.
SCALE = 20.0


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES
) -> Model:
    """Train on at most ``sample`` labelled documents of each label, ``sample_bytes`` of word counts in all.

    The hash of the id picks them.  Labels other than 0 and 1 and null ids are left out; an id labelled
    twice counts once, as its largest label; of rows that share an id one counts; null texts are empty.
    Word counts, not texts, come to the driver, and their bytes are bounded, so very long texts are
    counted whole or passed over.  Without documents of both labels the model scores every text by
    the share of label 1.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(F.max(label_col).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    picked = [usable.where(F.col("label") == k).orderBy(F.xxhash64("labelled"), "labelled").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # twice ``sample`` rows of two numbers at most
    texts = docs.select(F.col(id_col).alias("labelled"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(chosen, "labelled").select("labelled", "label", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([counted(t.as_py()) for t in batch.column(2)], pa.string())], names=["id", "label", "bag"])

    kind = texts.schema["labelled"].dataType.simpleString()
    listed = written(found.mapInArrow(bags, f"id {kind}, label int, bag string").groupBy("id", "label").agg(F.min("bag").alias("bag")), "word-counts")
    order = [F.xxhash64("id"), F.col("id")]
    sized = listed.where(F.octet_length("bag") <= sample_bytes // 8).select("*", F.sum(F.octet_length("bag") + 64).over(Window.partitionBy("label").orderBy(*order)).alias("so_far"))
    rows = sorted((r.id, r.label, r.bag) for r in sized.where(F.col("so_far") <= sample_bytes // 2).toLocalIterator())
    total = sum(counts.values())
    return train([b for _, _, b in rows], [y for _, y, _ in rows], counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model, text: Column) -> Column:
    """Column with the score of ``text`` in 0 to 1; null and empty texts score as the bias does.

    Each row is scored by itself, so repeated rows and very long texts need no care.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.number, model.bias))
    own: list[Model] = []

    @F.arrow_udf("double")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not own:
            own.append(Model(*held.value))
        for texts in batches:
            yield pa.array(own[0].scores(texts.to_pylist()), pa.float64())

    return udf(text.cast("string"))
