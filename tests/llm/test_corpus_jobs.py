"""Operators 5 to 10 and the pipeline against plain Python, round trips and held-out labels."""

from __future__ import annotations

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dossier.llm import components, decontamination, near_dedup, packing, quality, queries, token_files, tokens, toxicity


def table(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def plain_ids(rows):
    encode = tokens.ChunkEncoder(tokens.default_tokenizer()).tokenizer.encode
    return [(i, encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]


def test_chunked_ids_equal_whole_text_ids():
    e = tokens.ChunkEncoder(tokens.default_tokenizer())
    texts = ["", None, "a b", "a  b", " a", "a ", "a\nb c.\n\nd", "x y z", "don't stop, it's 12,5 o'clock.)", "日本 語. <|endoftext|> é", "a\tb\r\nc", "tail .", "..", "a. b! c? d) 'x'", "e.g. U.S.A. 3.14.", "\n", "a\n b", "Ünïcode wörds ﬁne ǅ ʰ Ⅷ ٣ x² e\u0301 naïve", "a\u2028b c\x1cd", "\ufeffa b", "été. été, été\nété. 日本語 日本語."]
    for _ in range(2):
        assert e.encode_many(texts) == [np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def check_packing(pieces, expected, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        assert p.length * 4 == len(p.ids) and p.ids_crc32 == zlib.crc32(p.ids)
    for seq in by_sequence.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == capacity or at & (at - 1) == 0
    want = Counter((i, tuple(ids)) for i, ids in expected)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append((p.start, tuple(np.frombuffer(p.ids, "<u4").tolist())))
    total = sum(len(ids) for i, ids in expected)
    assert sum(p.length for p in pieces) == total
    for (i, ids), times in want.items():
        starts = Counter()
        for start, part in by_doc[i, len(ids)]:
            if tuple(ids[start : start + len(part)]) == part:
                starts.update(range(start, start + len(part)))
        assert all(starts[k] >= times for k in range(len(ids)))


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packing_covers_every_id_once(docs, plain_ids, capacity):
    pieces = packing.pack_documents(docs, tokens.default_tokenizer(), capacity=capacity).collect()
    check_packing(pieces, plain_ids, capacity)


def test_level_choice_minimises_squares():
    rng = np.random.default_rng(1)
    packer = packing.LevelPacker(32)
    for i in range(400):
        size = int(rng.integers(1, 32))
        before = packer.count.copy()

        def squares(level, size=size, before=before):
            after = before.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return (after**2).sum()

        best = min(squares(h) for h in [0, *np.flatnonzero(before[: 33 - size])])
        packer.add(i, b"\0" * 4 * size)
        assert (packer.count**2).sum() == best


def test_close_cuts_one_window_and_splits_only_to_complete():
    rng = np.random.default_rng(4)
    for capacity in (32, 1024):
        packer, full, sizes = packing.LevelPacker(capacity), [], [int(x) for x in rng.integers(1, capacity, 500)]
        for i, size in enumerate(sizes):
            full += packer.add(i, bytes(4 * size))
        opened = int(packer.count.sum())
        closed = packer.close()
        short = [w for w in closed if sum(len(p[3]) // 4 for p in w) < capacity]
        assert sum(len(p[3]) // 4 for w in short for p in w) < capacity and not packer.count.any()
        assert sum(len(p[3]) // 4 for w in full + closed for p in w) == sum(sizes)
        pieces = sum(len(w) for w in full + closed) - len(sizes)
        assert pieces <= opened + len(short)  # a cut completes a window


def test_elias_fano_round_trip():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 0), (5, 3), (1000, 10), (3000, 10**9), (700, 700)):
        values = np.sort(rng.integers(0, top + 1, n))
        block = token_files.ef_encode(values)
        read = token_files.EliasFano(b"xx" + block, 2)
        assert read.n == n and read.end == 2 + len(block)
        assert [read.select(i) for i in range(n)] == values.tolist()
        assert len(block) * 8 <= n * (3 + np.log2(max(2, top / max(n, 1)))) + 500 + n


@pytest.mark.parametrize("file_bytes", [1 << 25, 500])
def test_token_files_round_trip(spark, docs, plain_ids, file_bytes):
    folder = token_files.token_folder(spark)
    manifest = token_files.write_token_files(docs, tokens.default_tokenizer(), folder, file_bytes=file_bytes)
    got = token_files.read_token_files(spark, folder, manifest).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == Counter((i, tuple(x)) for i, x in plain_ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)


def test_files_and_packing_take_empty_tables(spark, empty):
    folder = token_files.token_folder(spark)
    assert token_files.read_token_files(spark, folder, token_files.write_token_files(empty, tokens.default_tokenizer(), folder)).count() == 0
    assert packing.pack_documents(empty, tokens.default_tokenizer()).count() == 0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op7_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    score, label = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    better = (score[label == 1][:, None] > score[label == 0][None, :]).mean()
    assert better > 0.9 and ((score >= 0) & (score <= 1)).all()
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity_misspelling_and_odd_rows(spark, docs, rows, empty):
    rng = np.random.default_rng(4)
    syllables = ["ka", "lo", "mi", "ter", "un", "vo", "ras", "e", "din", "por"]
    text = lambda: ["".join(rng.choice(syllables, 3)) for _ in range(40)]
    made = [(i, " ".join(text() + ["idiot"] * (i % 2)), i % 2) for i in range(300)]
    model = toxicity.fit(spark.createDataFrame(made, "doc_id long, text string, y int"), spark.createDataFrame([(i, y) for i, _, y in made] + [(None, 1), (4, None), (5, 7)], "doc_id long, toxic int"))
    plain = text()
    model.learn(["idiot", "idioot", *plain])
    assert model.known["idiot"] > model.known["idioot"] > max(model.known[w] for w in plain)
    got = docs.select("doc_id", toxicity.score(docs, model, F.col("text")).alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.scores([None, "x"]) == none.scores(["", "y"])


def test_resampling_counts_and_selection(spark, docs, rows, empty):
    labels = spark.createDataFrame([(0, 1), (6, 1), (8, 0), (9, 0), (None, 1)], "doc_id long, quality int")
    ratio = quality.fit(docs, labels)
    raw, aim = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, t in rows:
        flat, _ = quality.ngram_buckets([t])
        words = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))
        assert len(flat) == max(0, 2 * words - 1)
        np.add.at(raw, flat, 1)
        if i in (0, 6):
            np.add.at(aim, flat, 1)
    assert np.allclose(ratio, np.log(aim / aim.sum()) - np.log(raw / raw.sum()))
    got = quality.resample(docs, labels, share=0.5).collect()
    chosen = [r for r in got if r.selected]
    assert len(got) == len(rows) and len(chosen) == round(len(rows) / 2)
    assert min(r.noisy for r in chosen) >= max(r.noisy for r in got if not r.selected) - 1e-9
    for r in got:
        texts = [t for i, t in rows if i == r.doc_id]
        assert any(abs(r.log_weight - ratio[quality.ngram_buckets([t])[0]].sum()) < 1e-6 for t in texts)
    assert quality.resample(empty, labels).count() == 0


@pytest.mark.parametrize("k", [0, 1, 3, 7, 12, 99])
def test_select_largest_breaks_ties_by_id(spark, k):
    values = [(i, v) for i, v in enumerate([5.0, 5.0, -3.5, 5.0, 0.0, 1e-6, -1e6, 2e5, 0.0, -0.25, 5.0, 7.5])]
    got = {r.doc_id for r in quality.select_largest(spark.createDataFrame(values, "doc_id long, noisy double"), k).where("selected").collect()}
    assert got == {i for i, _ in sorted(values, key=lambda x: (-x[1], x[0]))[:k]}


def test_select_largest_of_huge_sums_ties_and_odd_values(spark):
    far = [(i, 1e12 + i) for i in range(50)] + [(-i, -1e12 - i) for i in range(1, 50)]
    got = [r for r in quality.select_largest(spark.createDataFrame(far, "doc_id long, noisy double"), 60).collect() if r.selected]
    assert sorted(r.noisy for r in got) == sorted(v for _, v in far)[-60:]
    equal = [(i - 100, 1.5, 7) for i in range(200)] + [(None, 1.5, 7)] * 9 + [(5, float("nan"), 7), (6, None, 7), (2**62, 1.5, 7), (-(2**62), 1.5, 7)]
    data = spark.createDataFrame(equal, "doc_id long, noisy double, ordered int")
    order = lambda r: (r[1] is None or r[1] != r[1], r[0] is None, r[0] or 0)
    for k in (1, 150, 205, 211):
        found = quality.select_largest(data, k)
        assert found.columns == ["doc_id", "noisy", "ordered", "selected"]
        assert Counter(r.doc_id for r in found.collect() if r.selected) == Counter(r[0] for r in sorted(equal, key=order)[:k])


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(pairs):
    fps = {f for _, f in pairs}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = sorted(fps)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in fps}


def test_near_duplicates_match_plain_version(spark, sf, docs, rows):
    for data, plain in ((docs, rows), (table(spark, sf), [(r.doc_id, r.text) for r in table(spark, sf).collect()])):
        pairs = [(i, plain_fingerprint(t)) for i, t in plain]
        classes = plain_classes(pairs)
        got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_dedup.near_duplicates(data).collect())
        assert got == Counter((i, f, classes[f]) for i, f in pairs)


@pytest.mark.parametrize("block", [2, 10, 1 << 15])
def test_links_lose_no_class(spark, block):
    rng = np.random.default_rng(3)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            fps.add(centre ^ int(sum(1 << int(b) for b in flips)))
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    found = near_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block)
    roots = {r.node % (1 << 64): r.root for r in components.connected_components(found).collect()}
    classes = plain_classes([(k, f) for k, f in enumerate(fps)])
    groups = defaultdict(set)
    for f in fps:
        groups[roots.get(f, ("alone", f))].add(classes[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(classes.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 4), (4, 3), (None, 2), (200, 201)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_one_of_each_class_stays(docs, rows, empty):
    classes = plain_classes([(i, plain_fingerprint(t)) for i, t in rows])
    kept = near_dedup.keep_one_each(docs)
    assert kept.columns == docs.columns
    want = Counter(c for c in {(classes[plain_fingerprint(t)]) for i, t in rows if i is not None}) + Counter({None: sum(i is None for i, _ in rows)})
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert near_dedup.keep_one_each(empty).count() == 0


def test_texts_under_a_shared_id_stay(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(3, "same words here and there", "a"), (5, "same words here and there", "b"), (5, "another text of its own", "c"), (5, "another text of its own", "d"), (7, long, "e"), (7, long, "e"), (3, "third one under three", "f")]
    data = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    got = sorted((r.doc_id, r.text) for r in near_dedup.keep_one_each(data).collect())
    assert got == sorted([(3, rows[0][1]), (5, rows[2][1]), (7, long), (3, rows[6][1])])


def plain_matches(documents, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(name))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in documents:
        w, hit, found = words(t), set(), set()
        for p in range(len(w)):
            for n in sizes:
                if (key := tuple(w[p : p + n])) in windows and len(key) == n:
                    hit.update(range(p, p + n))
                    found |= windows[key]
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return Counter(out)


ITEMS = [(1, "gamma delta"), (2, None), (3, ""), (4, "REFERENCE Zebra one two three four five six seven eight nine ten eleven"), (10, "same"), (11, "same"), (5, "über ñandú été"), (6, "absent words only")]


@pytest.mark.parametrize("block_bytes", [1 << 23, 200])
def test_decontamination_matches_plain_version(spark, docs, rows, block_bytes):
    extra = [(50, "x zebra ONE two, three-four five six seven eight nine ten; y"), (51, "zebra one two three four five six seven eight nine"), (52, "reference zebra one two three four five six seven eight nine ten eleven same")]
    data = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = decontamination.benchmark_matches(data, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=block_bytes)
    got = found.select("doc_id", "matches.*").collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got) == plain_matches(rows + extra, ITEMS)
    longest = {r.doc_id: (r.longest, r.longest_item, r.longest_item_start, r.longest_start) for r in got}
    assert longest[50] == (10 + 1, "4", 1, 1) and longest[52] == (13, "4", 0, 0)


def test_one_shared_prompt_is_not_expanded():
    prompt = " ".join(f"w{i}" for i in range(50))
    tracemalloc.start()
    test = decontamination.TestSet([(str(i), f"{prompt} x{i}") for i in range(2000)])
    found = decontamination.search_shard([f"{prompt} y{i}" for i in range(2000)], test)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert len(found) == 2000 and found[7]["items"].as_py() == sorted(map(str, range(2000))) and found[7]["longest"].as_py() == 50


def test_suffix_array_and_longest_matches():
    rng = np.random.default_rng(5)
    for _ in range(200):
        ids = rng.integers(0, 4, rng.integers(1, 60))
        tail = lambda i, ids=ids: next((list(ids[i:j]) for j in range(i, len(ids)) if ids[j] == 0), list(ids[i:]))
        assert decontamination.suffix_array(ids, 64).tolist() == sorted(np.flatnonzero(ids).tolist(), key=lambda i: (tail(i), i))


def test_words_with_the_hash_of_a_test_word_do_not_match(monkeypatch):
    items = [("1", " ".join(f"w{i}" for i in range(12)))]
    real = decontamination.words_of
    monkeypatch.setattr(decontamination, "words_of", lambda raw: (real(raw)[0], np.ones(len(real(raw)[0]), np.uint64)))
    texts = [items[0][1], " ".join(f"v{i}" for i in range(12)), "w0 " + items[0][1]]
    # every word has one hash: only the bytes tell them apart, so no false match is reported
    found = decontamination.search_shard(texts, decontamination.TestSet(items)).to_pylist()
    assert found[1]["n_hit"] == 0


def test_decontamination_of_tables(spark, sf):
    documents, items = ([tuple(r) for r in table(spark, sf, n).select(k, "text").collect()] for n, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    found = decontamination.benchmark_matches(table(spark, sf).select("doc_id", "text"), table(spark, sf, "benchmark"))
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found.select("doc_id", "matches.*").collect())
    assert got == plain_matches(documents, items) and sum(k[2] > 0 for k in got) >= 3


def test_decontamination_without_items_or_documents(spark, docs, rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    renamed = decontamination.remove_contaminated(docs, none)
    assert renamed.count() == len(rows) and renamed.columns == docs.columns
    assert decontamination.remove_contaminated(empty, none).count() == 0
    with pytest.raises(ValueError):
        decontamination.benchmark_matches(docs, none)


def test_very_long_words_hash_like_short_pieces():
    raw = np.frombuffer(b"ab " + b"x" * (3 << 20) + b" ab", np.uint8)
    starts, hashes = decontamination.words_of(raw)
    assert starts.tolist() == [0, 3, 3 + (3 << 20) + 1] and hashes[0] == hashes[2] != hashes[1]
    part = np.frombuffer(b"x" * 2000, np.uint8)
    value = 0
    for byte in reversed(part.tolist()):
        value = (value * int(decontamination._P) + byte + 1) % (1 << 64)
    assert int(decontamination.words_of(part)[1][0]) == value


def test_pipeline_against_plain_steps(spark, sf):
    import corpus_pipeline

    documents = table(spark, sf)
    stages = {}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        stages[name] = docs
        if name != "packing":
            assert docs.columns == documents.columns
    kept = {n: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for n, d in stages.items() if n != "packing"}
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert 0.7 * len(texts) < len(kept["toxicity"]) < len(texts)
    classes = plain_classes([(i, plain_fingerprint(t)) for i, t in kept["toxicity"].items()])
    assert set(kept["simhash_dedup"]) == set(classes.values())
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    dirty = {k[0] for k in plain_matches(kept["simhash_dedup"].items(), items) if k[2]}
    assert set(kept["decontamination"]) == set(kept["simhash_dedup"]) - dirty
    assert set(kept["secrets"]) == set(kept["decontamination"])
    assert not any(re.search("[0-9a-f]{16,}", t) for t in kept["secrets"].values())
    encode = tokens.ChunkEncoder(tokens.default_tokenizer()).tokenizer.encode
    assert {r.doc_id: r.n for r in stages["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept["secrets"].items()}
