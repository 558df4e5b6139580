"""Operator 11: near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors of a label are one class with a count.  Spherical k-means, fitted on a bounded sample,
gives each class a home cell.  A class also visits each later cell whose members can be within the
angle of the threshold: with unit centroids c (home) and d, unit x and y, y nearer to d than to c and
x.y >= t, x.(c - d) is at most sqrt(1 - t^2) |c - d|.  Comparing each cell's homes with each other and
with its visitors therefore loses no pair, whatever the centroids are.  On vectors without clusters
nearly all cells are visited and the work is that of all pairs of a label, as products of blocks.

Cells of any size are dealt to pairs of blocks.  A pair of blocks gives each class the number of
vectors that it links to and a spanning forest of the links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.components import connected_components
from dossier.llm.shared import fresh, written

THRESHOLD = 0.93
#: Classes of a cell that one side of a product holds; larger cells go to several blocks.
BLOCK = 512
#: Classes of the largest label for each centroid, the most centroids, and the sampled vectors for each centroid.
CELL, MOST_CELLS, SAMPLE = 1024, 256, 64
SLACK = 1e-9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """``k`` unit centroids of the unit rows of ``x``: mean directions of the rows nearest to each by cosine."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 0
        c[full] = sums[full] / norms[full, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]  # a cell without members starts anew
    return c


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither the squares of large nor of small numbers may leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dim(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit rows for each length of vector."""
    dims = np.diff(vectors.offsets.to_numpy()) if not vectors.null_count else vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield at, _unit(vectors.take(pa.array(at)), dim)


def fit_cells(classes: DataFrame, cell: int = CELL, most: int = MOST_CELLS) -> np.ndarray:
    """Unit centroids for the commonest length of vector, from at most ``SAMPLE`` classes for each of ``most`` cells."""
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k = min(most, -(-largest // cell))
    if k < 2:
        return np.zeros((0, 0))
    common = classes.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()["dim"]
    rows = classes.where(F.size("v") == common).select("h1", "h2", "v").orderBy("h1", "h2").limit(SAMPLE * k).collect()
    x = _unit(pa.array([r.v for r in rows]), common)
    return spherical_kmeans(x, min(k, len(x)))


def visits(classes: DataFrame, centroids: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``(label, dim, cell, home, node, n, v)``: each class in its home cell and in the later cells it must visit."""
    reach = float(np.sqrt(max(0.0, 1 - threshold * threshold))) if threshold > 0 else 2.0
    apart = np.linalg.norm(centroids[:, None, :] - centroids[None, :, :], axis=2) if len(centroids) <= MOST_CELLS and len(centroids) else None

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            for at, x in _by_dim(v):
                home = np.zeros(len(at), np.int64)
                row, cell = np.arange(len(at)), home
                if apart is not None and x.shape[1] == centroids.shape[1]:
                    near = x @ centroids.T
                    home = near.argmax(axis=1)
                    gap = near[row, home][:, None] - near
                    must = (gap <= reach * apart[home] + SLACK) & (np.arange(len(centroids)) > home[:, None])
                    more, into = np.nonzero(must)
                    row, cell = np.concatenate([row, more]), np.concatenate([home, into])
                for some in range(0, len(row), 4096):
                    r = row[some : some + 4096]
                    took = batch.take(pa.array(at[r]))
                    cols = [took.column("label"), pa.array(np.full(len(r), x.shape[1], np.int32)), pa.array(cell[some : some + 4096].astype(np.int32)), pa.array(home[r] == cell[some : some + 4096])]
                    cols += [took.column("node"), took.column("n"), took.column("v")]
                    yield pa.RecordBatch.from_arrays(cols, names=["label", "dim", "cell", "home", "node", "n", "v"])

    kind = {f.name: f.dataType.simpleString() for f in classes.schema}
    return classes.select("label", "node", "n", "v").mapInArrow(cells, f"label {kind['label']}, dim int, cell int, home boolean, node long, n long, v {kind['v']}")


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are within the threshold; products beside it are taken again one by one."""
    cos = a @ b.T
    near = np.argwhere(np.abs(cos - threshold) < 1e-12)
    for i, j in near.tolist():
        cos[i, j] = float(np.dot(a[i], b[j]) / np.sqrt(np.dot(a[i], a[i]) * np.dot(b[j], b[j])))
    return cos >= threshold


def _forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of a bipartite table of links, as row and column numbers."""
    left, right = [], []
    rows, cols = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)
    rows &= linked.any(axis=1)
    while rows.any():
        queue = [(True, int(rows.argmax()))]
        rows[queue[0][1]] = False
        while queue:
            is_row, at = queue.pop()
            open_ = cols if is_row else rows
            hit = np.flatnonzero((linked[at] if is_row else linked[:, at]) & open_)
            open_[hit] = False
            queue += [(not is_row, h) for h in hit.tolist()]
            left += [at] * len(hit) if is_row else hit.tolist()
            right += hit.tolist() if is_row else [at] * len(hit)
    return left, right


def links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """``(a, b, n)``: with null ``b`` how many vectors of other classes ``a`` links to, in parts; else links that connect the classes.

    ``classes(label, h1, h2, v, n, node)``: distinct vectors without null or non-finite numbers, and their counts.
    """
    visiting = visits(classes, fit_cells(classes, cell), threshold)
    keys = ["label", "dim", "cell"]
    count = lambda flag: F.ceil(F.count_if(F.col("home") == flag) / block)
    sizes = written(visiting.drop("v", "n", "node").groupBy(*keys).agg(count(True).alias("homes"), count(False).alias("guests")).where("homes > 0"), "cell-sizes")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")))
    # pairs of blocks: homes i <= j; homes i with guests homes + g
    others = F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("homes") + F.col("guests") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1))
    dealt = visiting.join(sizes, keys).withColumn("own", F.when(F.col("home"), own).otherwise(own + F.col("homes"))).withColumn("other", F.explode(others))
    dealt = dealt.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "v")
    group = [*keys, "i", "j"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "own")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(part: pa.Table) -> pa.RecordBatch:
            own, i, j, node, n = (part.column(c).to_numpy() for c in ("own", "i", "j", "node", "n"))
            x = _unit(part.column("v").combine_chunks(), int(part.column("dim")[0].as_py()))
            left, right = own == i, own == j
            linked = _linked(x[left], x[right], threshold)
            if i[0] == j[0]:
                np.fill_diagonal(linked, False)
            a, b = node[left], node[right]
            counts = [(a, linked @ n[right])]
            if i[0] != j[0]:
                counts.append((b, n[left] @ linked))
            who, many = (np.concatenate(c) for c in zip(*counts))
            who, many = who[many > 0], many[many > 0]
            r, c = _forest(linked)
            cols = [np.concatenate([who, a[r]]), np.concatenate([np.zeros(len(who), np.int64), b[c]]), np.concatenate([many, np.zeros(len(r), np.int64)])]
            none = np.arange(len(cols[0])) < len(who)
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], mask=none), pa.array(cols[2])], names=["a", "b", "n"])

        rest: list[pa.RecordBatch] = []  # the last pair of blocks may go on in the next batch
        for batch in batches:
            rest.append(batch)
            part = pa.Table.from_batches(rest)
            edge = np.flatnonzero(np.any([_changes(part.column(c)) for c in group], axis=0)) + 1
            for s, e in zip([0, *edge[:-1].tolist()], edge.tolist()):
                yield found(part.slice(s, e - s))
            rest = part.slice(int(edge[-1]) if len(edge) else 0).to_batches()
        if sum(b.num_rows for b in rest):
            yield found(pa.Table.from_batches(rest))

    return dealt.mapInArrow(products, "a long, b long, n long")


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    codes = column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Rows of one label link at a cosine of ``threshold`` or more; ``component_id`` is the least id that links
    reach.  Rows without a label, and null, empty or zero vectors or ones with a null or non-finite number, link with
    nothing and are kept.  Vectors of different lengths do not link.  Repeated rows are rows: equal vectors
    of a label link to each other, and each row of the least id is kept.  A null id is no component's
    least, unless all are null.  An empty table gives no rows; other columns are not read.
    """
    v, label = F.col("v"), F.col("label")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    sound = label.isNotNull() & v.isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit("second"), "v"))
    key = ["label", "h1", "h2"]
    classes = rows.where("sound").groupBy(*key).agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = written(links(classes, threshold, block, cell), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    rooted = classes.select(*key, "node", "n", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "vector-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(least, "root").select(*key, (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "vector-components")
    light = rows.select("vec_id", "sound", *key)
    linked = light.where("sound").join(named, key).select("vec_id", "n_links", "component_id")
    alone = light.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def keep_one_each(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``vectors``, with all its columns, less the rows that link to one of a smaller id; rows without an id stay."""
    lost = fresh(vectors, "lost_id")
    gone = near_vectors(vectors, id_col, vector_col, label_col, threshold).where("not kept").select(F.col("vec_id").alias(lost)).distinct()
    return vectors.join(gone, vectors[id_col] == F.col(lost), "left_anti")
