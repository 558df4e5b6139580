"""Operator 13: the trie of conversation prefixes, rolled up by centroid decomposition of its parent-edge forest.

A turn is known by a digest of its role and text; a prefix by two sums, modulo 2^64, of a mix of each turn's digest and place.
Sums run in parallel: rows lie in ranges of (conversation, place), and each range starts from the totals of those before it,
so one conversation may hold any share of the rows.  Texts are never shuffled.

Rollup.  The root is taken off; each first turn is the top of a component.  A node's weight is the number of its members'
turns from its depth on within its component, known without a rollup.  Every component above a bound is split at its centroid,
the deepest node with over half of its weight: what is below goes to the components of the centroid's children,
the rest stays with the top.  All components of a level are split at once and each level halves the
largest, so there are about log2(turns) levels, and only rows of large components take part.  A task then solves whole
components below the bound in the same way, recursively.  Totals go back up: a centroid has its own value and
the totals of the components of its children, and adds it to each node on the path from its parent to the top of its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.shared import written

#: Weight of a component that one task solves on its own.
BOUND = 512
#: Ids of a node that one row of the digests' input holds.
PIECE = 4096
KEY, PARENT, TOP = ["k1", "k2"], ["p1", "p2"], ["t1", "t2"]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _boundaries(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of runs of equal rows."""
    return np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(columns[0]) else np.zeros(0, bool)


def lay_out(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, at, d1, d2, n_bytes)``: each turn's place in its conversation from 1, the digest of role and text, the text's UTF-8 bytes.

    Turns are ordered by ``turn_col``, null first, equal ones by their digest.  Null roles and texts are empty.
    Rows without a conversation's id belong to none and are left out.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), part(1).alias("d1"), part(16).alias("d2"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows may lie in several ranges
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2"), F.col("tie")]
    laid = rows.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order).select("conv", "d1", "d2", "n_bytes", F.spark_partition_id().alias("part"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_before, seen = None, 0
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if not len(conv):
                continue
            start = np.flatnonzero(_boundaries([conv]))
            at = np.arange(len(conv)) - np.repeat(start, np.diff([*start, len(conv)])) + 1
            if conv_before == conv[0]:
                at[: start[1] if len(start) > 1 else None] += seen
            conv_before, seen = conv[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "local"])

    numbered = written(laid.mapInArrow(number, "conv long, d1 long, d2 long, n_bytes long, part int, local long"), "turns-in-order")
    before = _carried(numbered.groupBy("conv", "part").agg(F.max("local").alias("n")), ["n"])
    return numbered.join(before, ["conv", "part"], "left").select("conv", (F.col("local") + F.coalesce("n_before", F.lit(0))).alias("at"), "d1", "d2", "n_bytes")


def _carried(pieces: DataFrame, columns: list[str]) -> DataFrame:
    """What the pieces of a conversation in earlier ranges sum to; only for the first piece of a range, so as many rows as ranges at most."""
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("conv", "part", *[F.sum(c).over(earlier).alias(f"{c}_before") for c in columns]).where(F.col(f"{columns[0]}_before").isNotNull())


def _mixed(lane: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of a digest and a place."""
    x = lane.view(np.uint64) + (at.view(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0xD6E8FEB86659FD93), (32, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def prefixes(steps: DataFrame) -> DataFrame:
    """``(conv, depth, k1, k2, p1, p2, n_bytes)``: for each turn the key of the prefix that it ends, and of the one before; ``(0, 0)`` is the root."""
    laid = steps.repartitionByRange(_parts(steps), "conv", "at").sortWithinPartitions("conv", "at").select("conv", "at", "d1", "d2", "n_bytes", F.spark_partition_id().alias("part"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_before, carry = None, [np.uint64(0)] * 2
        for batch in batches:
            conv, at = batch.column("conv").to_numpy(), batch.column("at").to_numpy()
            if not len(conv):
                continue
            start = np.flatnonzero(_boundaries([conv]))
            runs = np.diff([*start, len(conv)])
            out = []
            for lane, (name, salt) in enumerate((("d1", 1), ("d2", 7))):
                mixed = _mixed(np.ascontiguousarray(batch.column(name).to_numpy()), np.ascontiguousarray(at), salt)
                if conv_before == conv[0]:
                    mixed[:1] += carry[lane]
                total = np.cumsum(mixed, dtype=np.uint64)
                total -= np.repeat(np.where(start > 0, total[start - 1], np.uint64(0)), runs)
                carry[lane] = total[-1]
                out.append(total)
            conv_before = conv[-1]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("at"), batch.column("d1"), batch.column("d2"), batch.column("n_bytes"), batch.column("part"), *(pa.array(o.view(np.int64)) for o in out)], names=["conv", "at", "d1", "d2", "n_bytes", "part", "s1", "s2"])

    summed = written(laid.mapInArrow(sums, "conv long, at long, d1 long, d2 long, n_bytes long, part int, s1 long, s2 long"), "prefix-sums")
    # totals of a range's piece, as decimals, whose sum modulo 2^64 the next ranges start from
    pieces = summed.groupBy("conv", "part").agg(F.max(F.struct("at", "s1", "s2")).alias("end")).select("conv", "part", *[F.col(f"end.{s}").cast("decimal(38,0)").alias(s) for s in ("s1", "s2")])
    wrapped = lambda c: F.expr(f"CAST(CASE WHEN pmod({c}, 18446744073709551616BD) >= 9223372036854775808BD THEN pmod({c}, 18446744073709551616BD) - 18446744073709551616BD ELSE pmod({c}, 18446744073709551616BD) END AS BIGINT)")
    before = _carried(pieces, ["s1", "s2"]).select("conv", "part", wrapped("s1_before").alias("b1"), wrapped("s2_before").alias("b2"))
    joined = summed.join(before, ["conv", "part"], "left").select("conv", "at", "d1", "d2", "n_bytes", "s1", "s2", F.coalesce("b1", F.lit(0)).cast("long").alias("b1"), F.coalesce("b2", F.lit(0)).cast("long").alias("b2"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.ascontiguousarray(batch.column("at").to_numpy())
            own, before = [], []
            for name, sum_, base, salt in (("d1", "s1", "b1", 1), ("d2", "s2", "b2", 7)):
                key = batch.column(sum_).to_numpy().view(np.uint64) + batch.column(base).to_numpy().view(np.uint64)
                own.append(pa.array(key.view(np.int64)))
                before.append(pa.array((key - _mixed(np.ascontiguousarray(batch.column(name).to_numpy()), at, salt)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("at"), *own, *before, batch.column("n_bytes")], names=["conv", "depth", *KEY, *PARENT, "n_bytes"])

    return joined.mapInArrow(keys, "conv long, depth long, k1 long, k2 long, p1 long, p2 long, n_bytes long")


def _same(a: list[str], b: list[str]) -> Column:
    return (F.col(a[0]) == F.col(b[0])) & (F.col(a[1]) == F.col(b[1]))


def centroid_totals(parent: list[int], weight: list[int], own: list[tuple[int, int]]) -> list[list[int]]:
    """Sums of ``own`` over the subtrees of one component; nodes are in order of depth, node 0 is the top (its parent is -1)."""
    total = [list(v) for v in own]
    weight = list(weight)
    children: list[list[int]] = [[] for _ in parent]
    for v, p in enumerate(parent):
        if p >= 0:
            children[p].append(v)
    cut = [False] * len(parent)
    work: list[tuple[int, int]] = [(0, -1)]  # (top of a component, -1), or (-1, a centroid whose children's components are done)
    tops: dict[int, int] = {}
    while work:
        top, c = work.pop()
        if top < 0:
            for u in children[c]:
                if tops.get(u) == c:
                    total[c][0] += total[u][0]
                    total[c][1] += total[u][1]
            continue
        if c >= 0:  # the part above a centroid is done: add the centroid's total along its path
            add, v = total[c], parent[c]
            while True:
                total[v][0] += add[0]
                total[v][1] += add[1]
                if v == top:
                    break
                v = parent[v]
            continue
        all_, c = weight[top], top
        while True:
            heavy = next((u for u in children[c] if not cut[u] and 2 * weight[u] > all_), -1)
            if heavy < 0:
                break
            c = heavy
        cut[c] = True
        if c != top:
            w, v = weight[c], parent[c]
            while True:
                weight[v] -= w
                if v == top:
                    break
                v = parent[v]
            work += [(top, c), (top, -1)]
        work.append((-1, c))
        for u in children[c]:
            if not cut[u]:
                cut[u], tops[u] = True, c
                work.append((u, -1))
    return total


def _split(nodes: DataFrame, rows: DataFrame, bound: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Components of at most ``bound``: ``(t1, t2, k1, k2, weight)`` of their nodes, the centroids by level and the paths above them."""
    small, centroids, paths = [], [], []
    level, own = 0, nodes.select(*TOP, *KEY, "weight", "depth", F.col("conv_id").alias("rep"), *PARENT)
    while True:
        large = written(own.where(_same(KEY, TOP) & (F.col("weight") > bound)).select(*TOP, F.col("weight").alias("all")), "large-components")
        small.append(own.join(large, TOP, "left_anti").select(*TOP, *KEY, "weight"))
        if not large.take(1):
            break
        deepest = own.join(large, TOP).where("2 * weight > all").groupBy(*TOP).agg(F.max(F.struct("depth", *KEY, "rep")).alias("c"))
        cents = written(deepest.select(*TOP, F.col("c.k1").alias("c1"), F.col("c.k2").alias("c2"), F.col("c.depth").alias("at"), F.col("c.rep").alias("rep")), "centroids")
        centroids.append(cents.select(F.lit(level).alias("level"), "c1", "c2", *TOP))
        inside = rows.join(cents, TOP)
        child = _same(PARENT, ["c1", "c2"])
        crossing = inside.where(_same(KEY, ["c1", "c2"]) | child).groupBy(*TOP, "conv").agg(F.max(F.when(child, F.col("k1"))).alias("u1"), F.max(F.when(child, F.col("k2"))).alias("u2"))
        crossing = crossing.withColumn("crosses", F.lit(True))
        paths.append(written(inside.where("conv = rep and depth < at").select("c1", "c2", *KEY), "centroid-paths"))
        cut = inside.join(crossing, [*TOP, "conv"], "left").withColumn("crosses", F.coalesce("crosses", F.lit(False))).where("not crosses or depth != at")
        below = F.col("crosses") & (F.col("depth") > F.col("at"))
        last = F.when(F.col("crosses") & (F.col("depth") < F.col("at")), F.col("at") - 1).otherwise(F.col("last"))
        rows = written(cut.select("conv", "depth", *KEY, *PARENT, last.alias("last"), F.when(below, F.col("u1")).otherwise(F.col("t1")).alias("t1"), F.when(below, F.col("u2")).otherwise(F.col("t2")).alias("t2")), "component-rows")
        own = rows.groupBy(*TOP, *KEY).agg(F.sum(F.col("last") - F.col("depth") + 1).alias("weight"), F.max("depth").alias("depth"), F.min("conv").alias("rep"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
        own = written(own, "component-nodes")
        level += 1
    union = lambda dfs: None if not dfs else dfs[0] if len(dfs) == 1 else union([*dfs[:-2], dfs[-2].unionByName(dfs[-1])])
    return union(small), union(centroids), union(paths)


def rollup(nodes: DataFrame, rows: DataFrame, bound: int = BOUND) -> DataFrame:
    """``(k1, k2, n_leaves, saved)`` of each node below the root: sums of ``leaf`` and ``saving`` over its subtree.

    ``nodes(k1, k2, p1, p2, t1, t2, depth, weight, conv_id, leaf, saving)``; ``rows(conv, depth, k1, k2, p1, p2, last, t1, t2)``.
    """
    small, centroids, paths = _split(nodes, rows, bound)
    values = nodes.select(*KEY, *PARENT, "depth", "leaf", "saving")
    local = small.join(values, KEY).repartition(*TOP).sortWithinPartitions(*TOP, "depth")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: dict[str, list]) -> list[list[int]]:
            place = {k: i for i, k in enumerate(zip(t["k1"], t["k2"]))}
            above = [-1, *(place[p] for p in list(zip(t["p1"], t["p2"]))[1:])]
            return centroid_totals(above, t["weight"], list(zip(t["leaf"], t["saving"])))

        def found(part: pa.Table) -> Iterator[pa.RecordBatch]:
            start = np.flatnonzero(_boundaries([part.column(c).to_numpy() for c in TOP]))
            t = part.to_pydict()
            out: list[list[int]] = []
            for s, e in zip(start.tolist(), [*start[1:].tolist(), part.num_rows]):
                out += [[t["leaf"][s], t["saving"][s]]] if e - s == 1 else solved({k: v[s:e] for k, v in t.items()})
            cols = [part.column(c).combine_chunks() for c in (*KEY, *PARENT, *TOP)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([o[i] for o in out], pa.int64()) for i in (0, 1))], names=[*KEY, *PARENT, *TOP, "n_leaves", "saved"])

        rest: list[pa.RecordBatch] = []  # the last component may go on in the next batch
        for batch in batches:
            rest.append(batch)
            part = pa.Table.from_batches(rest)
            start = np.flatnonzero(_boundaries([part.column(c).to_numpy() for c in TOP]))
            if len(start) > 1:
                yield from found(part.slice(0, int(start[-1])))
                rest = part.slice(int(start[-1])).to_batches()
        if rest:
            yield from found(pa.Table.from_batches(rest))

    solved = local.mapInArrow(solve, "k1 long, k2 long, p1 long, p2 long, t1 long, t2 long, n_leaves long, saved long")
    if centroids is None:
        return solved.select(*KEY, "n_leaves", "saved")
    solved, centroids = written(solved, "component-totals"), written(centroids, "all-centroids")
    # a centroid's own value and the totals of the solved components below it; the centroid above its component, if any
    of_children = solved.where(_same(KEY, TOP)).select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), "n_leaves", "saved").groupBy("c1", "c2").agg(F.sum("n_leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"))
    top = nodes.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("p1").alias("up1"), F.col("p2").alias("up2"))
    base = centroids.join(nodes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "leaf", "saving"), ["c1", "c2"]).join(top, TOP).join(of_children, ["c1", "c2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    base = written(base.select("level", "c1", "c2", "up1", "up2", (F.col("leaf") + zero(F.col("below_leaves"))).alias("n_leaves"), (F.col("saving") + zero(F.col("below_saved"))).alias("saved")), "centroid-values")
    done = None
    for level in range(base.agg(F.max("level")).first()[0], -1, -1):
        now = base.where(F.col("level") == level)
        if done is not None:
            more = done.groupBy(F.col("up1").alias("c1"), F.col("up2").alias("c2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            now = now.join(more, ["c1", "c2"], "left").select("level", "c1", "c2", "up1", "up2", (F.col("n_leaves") + zero(F.col("more_leaves"))).alias("n_leaves"), (F.col("saved") + zero(F.col("more_saved"))).alias("saved"))
        now = written(now, "centroid-totals")
        done = now if done is None else done.unionByName(now)
    to_path = paths.join(done, ["c1", "c2"]).select(*KEY, "n_leaves", "saved")
    every = solved.select(*KEY, "n_leaves", "saved").unionByName(done.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "n_leaves", "saved")).unionByName(to_path)
    return every.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def id_digests(ends: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)`` of ``ends(k1, k2, conv)``: SHA-256 of each key's ids, ascending, decimal, comma-joined.

    Ids are joined to pieces where they lie in order; a key's pieces then pass through one hash, which SHA-256 needs, without being held.
    """
    laid = ends.repartitionByRange(_parts(ends), *KEY, "conv").sortWithinPartitions(*KEY, "conv").select(*KEY, "conv", F.spark_partition_id().alias("part"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            start = np.flatnonzero(_boundaries([batch.column(c).to_numpy() for c in KEY]))
            ids = batch.column("conv").to_pylist()
            cuts = [(i, min(i + PIECE, e)) for s, e in zip(start.tolist(), [*start[1:].tolist(), len(ids)]) for i in range(s, e, PIECE)]
            first = pa.array([s for s, _ in cuts])
            pieces = pa.array([",".join(map(str, ids[s:e])) for s, e in cuts])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(first) for c in (*KEY, "part")] + [pa.array(range(at, at + len(cuts)), pa.int64()), pieces], names=[*KEY, "part", "at", "ids"])
            at += len(cuts)

    pieces = laid.mapInArrow(join, "k1 long, k2 long, part int, at long, ids string").repartition(*KEY).sortWithinPartitions(*KEY, "part", "at").select(*KEY, "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for key, ids in zip(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()), batch.column("ids").to_pylist()):
                if key == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield _named(out)
        if now is not None:
            yield _named([(*now, sha.hexdigest())])

    return pieces.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _named(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    k1, k2, sha = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha)], names=[*KEY, "ends_sha256"])


def trie(steps: DataFrame, convs: DataFrame, bound: int = BOUND) -> DataFrame:
    """The nodes of the trie of ``steps(conv, at, d1, d2, n_bytes)``; ``convs(conv)`` names every conversation, also those without turns."""
    rows = written(prefixes(steps), "prefix-rows")
    convs = convs.select("conv").distinct()
    path = rows.groupBy("conv").agg(F.max(F.struct("depth", *KEY)).alias("end"), F.min(F.struct("depth", *KEY)).alias("top"))
    path = written(convs.join(path.select("conv", F.col("end.depth").alias("last"), F.col("end.k1").alias("e1"), F.col("end.k2").alias("e2"), F.col("top.k1").alias("t1"), F.col("top.k2").alias("t2")), "conv", "left"), "conversation-paths")
    rows = written(rows.join(path.where("last is not null").select("conv", "last", *TOP), "conv"), "rows-with-ends")
    weight = F.sum(F.col("last") - F.col("depth") + 1).alias("weight")
    nodes = rows.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("t1").alias("t1"), F.max("t2").alias("t2"), F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n_convs"), weight)
    nodes = written(nodes, "trie-nodes")
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    least = path.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")).unionByName(least.select(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.col("conv_id").alias("parent_conv_id")))
    valued = nodes.join(children, KEY, "left").join(parents, PARENT).withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    valued = written(valued.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saving", (F.col("n_convs") - 1) * F.col("n_bytes")), "valued-nodes")
    totals = written(rollup(valued, rows, bound), "trie-totals")
    ends = id_digests(path.select(F.coalesce("e1", F.lit(0)).alias("k1"), F.coalesce("e2", F.lit(0)).alias("k2"), "conv"))
    ends = written(ends, "trie-ends")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")]
    below = valued.join(totals, KEY).join(ends, KEY, "left").select(*out)
    tops = valued.where("depth = 1").select(*KEY).join(totals, KEY).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    one = {"conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved": "long", "ends_sha256": "string"}
    of_root = [least, tops, ends.where("k1 = 0 and k2 = 0").select("ends_sha256")]  # a row each, which one row takes up
    padded = [df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in one.items()]) for df in of_root]
    root = padded[0].unionByName(padded[1]).unionByName(padded[2]).agg(*[F.max(c).alias(c) for c in one]).where("n_convs > 0")
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved"), "ends_sha256")
    return below.unionByName(root.select(*out))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bound: int = BOUND) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: each distinct prefix of a conversation.

    ``conv_id`` is the least member, ``saved_tokens`` the bytes of text that sharing saves in the subtree.  Null
    roles and texts are empty; equal turns are ordered by a digest of role and text, so repeated rows are turns of their
    own.  Rows without a conversation's id are left out, texts of any length move as digests only, other columns are not
    read.  An empty table gives no rows, not even a root.
    """
    laid = written(lay_out(turns, conv_col, turn_col, role_col, text_col), "turns-in-place")
    return trie(laid, laid.select("conv"), bound)


def spliced(laid: DataFrame, donor: Column, taken: Column) -> DataFrame:
    """``laid`` with each conversation's first ``taken`` turns replaced by as many first turns of the conversation ``donor`` (all if it has fewer, none if absent).

    ``donor`` and ``taken`` are expressions over ``conv``; ``taken`` is small, for it bounds the turns that are copied.
    """
    lengths = laid.groupBy("conv").agg(F.max("at").alias("n"))
    plan = written(lengths.select("conv", "n", donor.alias("donor"), taken.cast("long").alias("taken")), "splices")
    given = plan.where("donor != conv").select(F.col("conv").alias("to"), "donor", "taken")
    from_donor = laid.join(given.withColumnRenamed("donor", "conv"), "conv").where("at <= taken")
    kept = plan.join(lengths.select(F.col("conv").alias("donor"), F.col("n").alias("n_donor")), "donor", "left").select("conv", "taken", (F.col("donor") == F.col("conv")).alias("own"), F.least("taken", F.coalesce("n_donor", F.lit(0))).alias("put"))
    stayed = laid.join(kept, "conv").where("own or at > taken")
    stayed = stayed.withColumn("at", F.when(F.col("own"), F.col("at")).otherwise(F.col("at") - F.col("taken") + F.col("put")))
    columns = ["at", "d1", "d2", "n_bytes"]
    return stayed.select("conv", *columns).unionByName(from_donor.select(F.col("to").alias("conv"), *columns))
