"""Scores of operator 7 and noise of operator 8 by plain versions."""

from __future__ import annotations

import math
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dossier.llm import quality, toxicity

MASK, PRIME = (1 << 64) - 1, 0x9E3779B97F4A7C15


def plain_buckets(word: str, buckets: int) -> list[int]:
    points = [ord(c) for c in f"<{word}>"]
    values = [sum(p * (p + 0x9E37) * pow(PRIME, k + 1, 1 << 64) for k, p in enumerate(points)) & MASK]
    for n in (3, 4):
        for at in range(len(points) - n + 1):
            value = 0
            for p in points[at : at + n]:
                value = (value ^ p) * PRIME & MASK
            values.append(value + n & MASK)
    mixed = [(v ^ v >> 31) * PRIME & MASK for v in values]
    return [(v >> 24) % buckets for v in mixed]


def plain_score(text: str | None, number: np.ndarray, bias: float) -> float:
    bag = Counter("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())
    total = sum(math.sqrt(n) for n in bag.values()) + toxicity.PRIOR_WORDS
    odds = bias + sum(math.sqrt(n) * float(np.mean(number[plain_buckets(w, len(number))])) for w, n in bag.items()) / total
    return 1 / (1 + math.exp(-max(-30, min(30, odds))))


def test_toxicity_scores_match_plain_version(spark, docs, rows):
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS) * 20, -0.7)
    got = Counter((r.doc_id, round(r.s, 9)) for r in docs.select("doc_id", toxicity.score(docs, model, F.col("text")).alias("s")).collect())
    want = Counter((i, round(plain_score(t, model.number, model.bias), 9)) for i, t in rows)
    assert got == want
    words = ["a", "idiot", "été", "日本", "x" * 300]
    flat, first = toxicity.subwords(words)
    assert [sorted(flat[s:e].tolist()) for s, e in zip(first, [*first[1:], len(flat)])] == [sorted(plain_buckets(w, toxicity.BUCKETS)) for w in words]


def test_a_trained_model_puts_toxic_words_above_others(spark):
    made = [(i, "calm river stone " * 5 + ("idiot clown " if i % 2 else "cloud field "), i % 2) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(made, "doc_id long, text string, y int"), spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, toxic int"))
    for text in ("calm idiot", "idiots and clowns", "cloud"):
        assert model.scores([text])[0] == pytest.approx(plain_score(text, model.number, model.bias))
    assert model.scores(["idiot clown"])[0] > model.scores(["cloud field"])[0]


def test_gumbel_numbers_match_plain_version(spark, docs):
    def gumbel(i, seed=8):
        first = 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        mixed = xxhash.xxh64_intdigest(struct.pack("<i", seed), first)
        return -math.log(-math.log(((mixed >> 11) + 0.5) / (1 << 53)))

    scored = quality.weigh(docs, np.zeros(quality.BUCKETS)).collect()
    assert len(scored) == docs.count()
    for r in scored:
        assert r.log_weight == 0 and r.noisy == pytest.approx(gumbel(r.doc_id), abs=1e-9)
