"""Stored results in pages: files read, totals, tokens."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dossier import scratch
from dossier.operators import paging
from dossier.sources import pages


def test_pages_read_their_files_and_tokens_are_bound(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 777 == 1, None).otherwise("large|odd").alias("axis"), (F.col("id") * 7919 % 100).alias("score"), "id")
    path = scratch.shared_folder(spark, "pages")
    held = paging.store(rows, "axis", ["-score", "id"], path, query="q1", rows_per_file=300)
    want = {}
    for r in rows.collect():
        want.setdefault(r.axis, []).append((-r.score, r.id))
    for axis, listed in want.items():
        listed.sort(key=lambda x: (x[0], x[1]))
        token, seen = held.token(axis, 400), 0
        while token:
            page, token = held.page(token)
            assert len(page.inputFiles()) <= 4  # of about seventeen
            got = page.orderBy("place").collect()
            assert [(-r.score, r.id) for r in got] == listed[seen : seen + 400] and [r.place for r in got] == list(range(seen + 1, seen + 1 + len(got)))
            assert all(r.total == len(listed) and r.remaining == max(0, len(listed) - seen - 400) for r in got)
            seen += len(got)
        assert seen == len(listed)
    every = held.read(dict.fromkeys(held.axes(), 5), 2)
    assert sorted((str(r.axis), r.place) for r in every.collect()) == sorted((str(a), p) for a, x in want.items() for p in (6, 7) if p <= len(x))
    again = paging.opened(spark, path)
    assert again.page(held.token("small", 3))[0].count() == 3 and again.revision == held.revision
    other = paging.store(rows.where("id > 0"), "axis", ["-score", "id"], scratch.shared_folder(spark, "pages"), query="q1")
    asked = paging.store(rows, "axis", ["-score", "id"], scratch.shared_folder(spark, "pages"), query="q2")
    assert asked.revision == held.revision != other.revision
    for wrong in (other.token("small", 3), asked.token("small", 3), held.token("small", 3, 10**6), held.token("small", 3, -1), "nonsense", ""):
        with pytest.raises(ValueError):
            held.page(wrong)
    with pytest.raises(ValueError):
        held.page(held.token("small", 501))
    with pytest.raises(FileExistsError):
        scratch.publish_text(spark, f"{path}/manifest.json", "{}")
    empty = paging.store(rows.limit(0), "axis", ["id"], scratch.shared_folder(spark, "pages"))
    assert empty.axes() == [] and empty.read({"small": 0}, 5).count() == 0


def test_a_snapshot_lies_in_files_by_rows_not_by_pages(spark, tmp_path):
    keys = [*range(3000, 0, -1), 7, 7, None]
    data = [(k, "long " * 1000 if k == 5 or k is None else None if k == 9 else f"text {i}") for i, k in enumerate(keys)]
    made = spark.createDataFrame(data, "k long, t string").repartition(5)
    kept, texts = pages.write_snapshot(made, str(tmp_path / "snapshot"), "k", "t", 10, rows_per_file=400)
    got = kept.orderBy("position").collect()
    assert [r.position for r in got] == list(range(3003)) and [r.page_bucket for r in got] == [i // 10 for i in range(3003)]
    assert [r.k for r in got] == [*range(1, 7), 7, 7, 7, *range(8, 3001), None]  # equal keys once each, nulls last as in SQL
    own = dict(sorted((k, t) for k, t in data if k is not None and k != 7))
    assert all(r.inline_text == (None if r.k == 5 else own[r.k]) for r in got if r.k in own) and len({r.inline_text for r in got if r.k == 7}) == 3
    assert {r.k for r in got if r.in_side_table} == {5, None} and [tuple(r) for r in texts.collect()] == [(got[4].digest, "long " * 1000)]
    files = list((tmp_path / "snapshot/rows").rglob("*.parquet"))
    assert len(files) <= 9  # 301 pages
    for file in files:  # each holds neighbouring pages, in order
        held = [r.position for r in spark.read.parquet(str(file)).select("position").collect()]
        assert held == list(range(min(held), max(held) + 1))
    empty, _ = pages.write_snapshot(made.limit(0), str(tmp_path / "empty"), "k", "t")
    assert empty.count() == 0
    words, _ = pages.write_snapshot(made.where("t like 'text%'"), str(tmp_path / "words"), "t", "t", rows_per_file=100)
    ordered = sorted(t for _, t in data if t and t.startswith("text"))
    assert [r.t for r in words.orderBy("position").select("t").collect()] == ordered
