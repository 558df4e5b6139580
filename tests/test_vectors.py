"""Stored vectors: exact neighbours, skipped cells, zeros, nulls, ties, scopes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier import scratch
from dossier.operators import vectors


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def plain(data, asked, k):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1.0)
    out = []
    for q, v in asked:
        if v is not None:
            scored = sorted((-round(float(unit(v) @ unit(w)), 6) + 0.0, i) for i, w in data if w is not None)[:k]
            out += [(q, i, -s + 0.0, rank) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("tight", [0.05, 1.0])
def test_nearest_is_exact_and_skips_far_cells(spark, tight):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    data = [(f"v{i:04d}", (centres[i % 12] + rng.normal(size=16) * tight).tolist()) for i in range(600)]
    data += [("same1", data[3][1]), ("same2", data[3][1]), ("zero", [0.0] * 16), ("null", None)]
    asked = [("a", data[3][1]), ("b", data[100][1]), ("c", rng.normal(size=16).tolist()), ("z", [0.0] * 16), ("n", None)]
    df, wanted = spark.createDataFrame(data, "id string, v array<float>").repartition(3), spark.createDataFrame(asked, "query_id string, embedding array<double>")
    data = [(r.id, r.v) for r in df.collect()]
    held, told = vectors.store(df, "id", "v", scratch.shared_folder(spark, "cells"), cell=25), []
    assert len(held.pivots) == 24 and held.zeros == 1
    found = rows(vectors.nearest(held, wanted, 5, told=told))
    assert [(q, i, round(s, 5), r) for q, i, s, r in found] == [(q, i, round(s, 5), r) for q, i, s, r in plain(data, asked, 5)]
    some = spark.createDataFrame([(a,) for a in asked if a[0] in "abc"], "r struct<query_id: string, embedding: array<double>>").select("r.*")
    share = []
    vectors.nearest(held, some, 5, told=share).count()
    assert share[0] < (0.35 if tight < 1 else 1.01)
    within = df.where(F.col("id") < "v0004").select("id")  # fewer than k
    few = [r for r in data if r[0] < "v0004"]
    assert [(q, i, r) for q, i, _, r in rows(vectors.nearest(held, wanted, 5, within=within))] == [(q, i, r) for q, i, _, r in plain(few, asked, 5)]


def test_nothing_stored_or_asked_and_unequal_lengths(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    held = vectors.store(empty, "id", "v", scratch.shared_folder(spark, "cells"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert vectors.nearest(held, asked, 3).collect() == []
    held = vectors.store(spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "id long, v array<double>"), "id", "v", scratch.shared_folder(spark, "cells"))
    assert vectors.nearest(held, asked.limit(0), 3).collect() == [] and [r.id for r in vectors.nearest(held, asked, 3).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        vectors.nearest(held, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), 3)


def test_words_are_hashed_where_they_are_read_and_vectors_filled_in_batches(spark):
    from hashlib import sha256

    from dossier.operators import search

    docs = spark.createDataFrame([("a", "One two two"), ("b", None), ("c", "..."), ("d", "x"), ("d", "x y")], "id string, text string")
    sparse = search.hash_embedding(docs, "id", "text", 16)
    plan = sparse._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "MapInArrow" in plan  # words were exploded and grouped first
    sparse = {(r.id, r.bucket): r.weight for r in sparse.collect()}
    place = lambda w: (int(sha256(w.encode()).hexdigest()[:8], 16) % 16, 1 - 2 * (int(sha256(w.encode()).hexdigest()[8], 16) % 2))
    for key, words in (("a", ["one", "two", "two"]), ("d", ["x", "x", "y"])):
        sums = [0] * 16
        for w in words:
            sums[place(w)[0]] += place(w)[1]
        norm = sum(v * v for v in sums) ** 0.5
        assert {b: w for (i, b), w in sparse.items() if i == key} == {b: round(v / norm, 6) for b, v in enumerate(sums) if v}
    assert {i for i, _ in sparse} == {"a", "d"}
    filled = search.dense(spark.createDataFrame([(1, 0, 0.6), (1, 3, 0.8), (1, 9, 1.0), (2, 2, 1.0)], "id long, bucket long, weight double"), "id", 4)
    assert {r.id: list(r.embedding) for r in filled.collect()} == {1: [0.6, 0.0, 0.0, 0.8], 2: [0.0, 0.0, 1.0, 0.0]}
    assert "try_element_at" not in filled._jdf.queryExecution().optimizedPlan().toString()  # a search of a map for each of the places
