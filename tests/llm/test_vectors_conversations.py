"""Vectors and conversations: plain versions, nulls, ties, long conversations, planted copies."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, difference

from dossier.llm import embedding_dedup, prefix_trie, queries, repair

NAMES = ["op11_embedding_dedup", "op12_conversation_repair", "op13_prefix_trie"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    assert difference(queries.queries()[name](spark, sf), queries.oracle_sql()[name], connect(sf)) == ""


# vectors


def planted_vectors() -> list[tuple]:
    rng = np.random.default_rng(4)
    rows: list[tuple] = []
    add = lambda v, label: rows.append((len(rows), None if v is None else [None if x is None else float(x) for x in v], label, "x"))
    for label in (0, 1):
        for _ in range(8):
            centre = rng.normal(size=12)
            for _ in range(15):
                add(centre + rng.normal(size=12) * rng.choice([0.05, 0.2, 0.4]), label)
    for _ in range(30):
        add([1, 2, 3], 1)  # one very common vector, of another length
    for special in (None, [], [0.0] * 12, [1.0] * 11 + [None], [float("nan")] * 12, [float("inf")] + [1.0] * 11):
        add(special, 0)
    for v in ([1e30] * 12, [1e-30] * 12, [1.0] * 12, [-1.0] * 12):
        add(v, 3)
    add([1.0] * 12, None)
    add([1.0] * 12, None)
    return rows


def plain_vectors(rows: list[tuple], threshold: float) -> Counter:
    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in (*a, *b)) or not any(a) or not any(b):
            return -2
        a, b = (np.array(x, np.float64) / np.abs(x).max() for x in (a, b))
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    n = len(rows)
    linked = [[i != j and rows[i][2] is not None and rows[i][2] == rows[j][2] and cosine(rows[i][1], rows[j][1]) >= threshold for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, work = {i}, [i]
        while work:
            at = work.pop()
            more = [j for j in range(n) if linked[at][j] and j not in seen]
            seen.update(more)
            work += more
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], sum(linked[i]), least, rows[i][0] == least))
    return Counter(out)


VECTORS = "vec_id long, embedding array<double>, label int, h1 string"


@pytest.mark.parametrize(("block", "cell"), [(512, 1024), (7, 20), (1000, 10)])
def test_near_vectors_match_plain_version(spark, block, cell):
    rows = planted_vectors()
    rows += [rows[0], (None, rows[1][1], 0, "x"), (None, None, 0, "x")]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = embedding_dedup.near_vectors(df, block=block, cell=cell)
    assert Counter(tuple(r) for r in found.collect()) == plain_vectors(rows, 0.93)


def test_vectors_of_empty_tables_and_kept_rows(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    rows = planted_vectors()
    df = spark.createDataFrame(rows, VECTORS)
    kept = embedding_dedup.keep_one_each(df)
    assert kept.columns == df.columns
    assert {r.vec_id for r in kept.collect()} == {i for i, _, _, keep in plain_vectors(rows, 0.93) if keep}


def test_cells_of_clusters_skip_most_visits(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 64))
    rows = [(i, (centres[i % 16] + rng.normal(size=64) * 0.1).tolist(), 1) for i in range(800)]
    df = spark.createDataFrame(rows, "node long, v array<double>, label int").selectExpr("*", "1L as n", "node as h1", "node as h2")
    visits = embedding_dedup.visits(df, embedding_dedup.fit_cells(df, cell=50)).count()
    assert visits < 3 * 800  # of up to 16 cells each


# conversations


def best_edits(rows: list[tuple[str, str, str]]) -> tuple[int, str, tuple]:
    """Forward search over (turns read, state) for the least (cost, audit)."""
    moves = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    insert = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def put(states, q, found):
        if q not in states or found[:2] < states[q][:2]:
            states[q] = found

    def inserted(states):
        for _ in range(2):
            for q, (cost, audit, out) in list(states.items()):
                put(states, insert[q][0], (cost + 5, audit + "I", (*out, (insert[q][1], ""))))
        return states

    states = inserted({0: (0, "", ())})
    for role, text, fault in rows:
        after: dict = {}
        for q, (cost, audit, out) in states.items():
            put(after, q, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            paid = 5 if fault == "truncated" else 0
            if (role[:1], q) in moves:
                put(after, moves[role[:1], q], (cost + paid, audit + "K", (*out, (role, text))))
            put(after, insert[q][0], (cost + 1 + paid, audit + "R", (*out, (insert[q][1], text))))
        states = inserted(after)
    return min((states[q] for q in (0, 3) if q in states), key=lambda s: s[:2])


def plain_audits(rows: list[tuple]) -> dict:
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        seen, faults, told = set(), Counter(), []
        for _, role, text in turns:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            told.append((role, text, fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        known = [t for t, _, _ in turns if t is not None]
        cost, audit, lines = best_edits(told)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha)
    return out


def planted_turns(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    text = lambda: rng.choice(["", " \n\x0b", None, "cut off", "Done.", "Done.", "Yes!\n", "日本。", "x" * 30 + "?"]) if rng.random() < 0.6 else f"{rng.random()}."
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "super"])
    rows = []
    for conv in [*range(12), None]:
        place = 0
        for _ in range(rng.choice([1, 2, 5, 9, 60])):
            place += rng.choice([1, 1, 1, 2])
            row = (conv, rng.choice([place] * 8 + [None]) if conv != 3 else None, role(), text())
            rows += [row] * rng.choice([1, 1, 1, 2])
    seen = set()  # turns of one number have no order of their own
    rows = [r for r in rows if r[:2] not in seen and not seen.add(r[:2]) or rows.count(r) > 1 and [q for q in rows if q[:2] == r[:2]] == [r] * rows.count(r)]
    rng.shuffle(rows)
    return rows


TURNS = "conv_id long, turn long, role string, text string, chunk string, flaw int"


@pytest.mark.parametrize(("seed", "chunk"), [(1, 4096), (2, 4), (3, 1), (4, 7)])
def test_audits_match_plain_version(spark, seed, chunk):
    rows = planted_turns(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(3)
    found = {r[0]: tuple(r[1:]) for r in repair.audits(df, chunk=chunk).collect()}
    assert found == plain_audits(rows)
    lines = defaultdict(list)
    for r in repair.repair(df, chunk=chunk).orderBy("chunk", "at").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, (*_, sha) in found.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == sha


def test_one_conversation_of_many_chunks_converges(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), f"{i}" + rng.choice([".", ""])) for i in range(5000)]
    names = []
    plain = repair.written
    monkeypatch.setattr(repair, "written", lambda df, name: names.append(name) or plain(df, name))
    found = {r[0]: tuple(r[1:]) for r in repair.audits(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk=64).collect()}
    assert found == plain_audits(rows)
    assert names.count("stale-chunks") <= 3


def test_damage_and_conversations_that_vanish(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Hello {t}. Good!") for c in range(40) for t in range(4)] + [(c, 0, "user", "alone.") for c in range(100, 180)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{c}:{t}".encode()) % 20
        if fault:
            want += [(c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)] * (2 if fault == 3 else 1)
    assert Counter(tuple(r) for r in repair.damaged(df).collect()) == Counter(want)
    assert len({c for c, *_ in rows}) > len({c for c, *_ in want})
    assert repair.audits(df.limit(0)).collect() == [] and repair.repair(df.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    made = repair.damaged(nulls).collect()
    assert set(map(tuple, made)) <= {(None, None, "user", " "), (None, None, " ", " "), (None, None, " ", "")}


# prefixes


def plain_trie(sequences: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(sequences):
        for d in range(len(sequences[c]) + 1):
            members[tuple(sequences[c][:d])].append(c)
        ends[tuple(sequences[c])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += k not in children
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return {(m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items()}


def branching(seed: int, n: int) -> list[tuple]:
    """Conversations of which many share long beginnings, and one long chain."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        length = 80 if c % 29 == 0 else rng.choice([1, 2, 3, 6, 12])
        rows += [(c, t, "user", "hot" if t < rng.choice([1, 5, 30]) else rng.choice(["a", "bé", "c"])) for t in range(length)]
    return rows + [(None, 0, "user", "no conversation"), (n, None, None, None), (n, 4, "user", None), (n + 1, 0, "user", "hot")] * 1 + [(n + 2, 0, "u", "er")] * 3


@pytest.mark.parametrize(("seed", "bound"), [(1, 512), (2, 16), (3, 1)])
def test_trie_matches_plain_version(spark, seed, bound):
    rows = branching(seed, 60)
    sequences = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        sequences[c].append((role or "", text or ""))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    found = prefix_trie.prefix_trie(df, bound=bound).collect()
    assert {tuple(r) for r in found} == plain_trie(sequences) and len(found) == len({tuple(r) for r in found})


def test_rebuilt_conversations_match_plain_version(spark):
    rng = random.Random(3)
    own = {c: [("user", rng.choice("ab")) for _ in range(rng.choice([1, 2, 4, 9, 12]))] for c in range(80) if c % 7 != 3}
    df = spark.createDataFrame([(c, t, *turn) for c, turns in own.items() for t, turn in enumerate(turns)], "conv_id long, turn long, role string, text string")
    df.createOrReplaceTempView("some_conversations")
    table = queries._table
    try:
        queries._table = lambda *_: df
        found = {tuple(r) for r in queries.op13_prefix_trie(spark, "").collect()}
    finally:
        queries._table = table
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    assert found == plain_trie({c: own.get(c - c % 5, [])[: h(c)] + own[c][h(c) :] for c in own})


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).collect() == []
    convs = spark.createDataFrame([(7,), (3,), (7,)], "conv long")
    found = prefix_trie.trie(prefix_trie.lay_out(empty), convs).collect()
    assert {tuple(r) for r in found} == plain_trie({3: [], 7: []})


@pytest.mark.parametrize("seed", range(20))
def test_centroid_totals(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 10, 200])
    parent = [-1] + [rng.randrange(max(0, i - rng.choice([1, 3, 200])), i) for i in range(1, n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    order = sorted(range(n), key=lambda i: depth[i])
    place = {v: i for i, v in enumerate(order)}
    parent = [-1 if parent[v] < 0 else place[parent[v]] for v in order]
    own = [(rng.randrange(3), rng.randrange(100)) for _ in range(n)]
    weight, want = [rng.choice([1, 1, 5]) for _ in range(n)], [list(v) for v in own]
    for v in range(n - 1, 0, -1):
        weight[parent[v]] += weight[v]
        want[parent[v]] = [a + b for a, b in zip(want[parent[v]], want[v])]
    assert prefix_trie.centroid_totals(parent, weight, own) == want
