"""Stored vectors, in cells around pivots, and exact nearest neighbours that skip cells.

Every vector lies in the cell of the pivot with the largest cosine; a cell keeps its radius, the largest angle to its pivot.  Angles
between directions obey the triangle inequality, so no vector of a cell is nearer to a query than the pivot's angle
less the radius.  A search first compares each query with the cells nearest to it until they hold k vectors, takes the k-th
score as the bound, and then only reads the cells that can hold a better or an equal one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier import scratch
from dossier.operators.index import _state_of

#: Vectors of a cell aimed at, the most cells, the most vectors that pivots are fitted on, and bytes of the queries of one block.
CELL, MOST_CELLS, SAMPLE, BLOCK_BYTES = 256, 512, 16_384, 64 << 20
#: Scores are rounded to so many digits; a bound allows for that.
DIGITS, SLACK = 6, 1.1e-6
_stored: dict[tuple[str, str], tuple[list, Vectors]] = {}


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if len(np.unique(column.value_lengths().to_numpy(zero_copy_only=False))) > 1:
        raise ValueError("vectors differ in their dimensions")
    return rows


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1.0)


def best(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, row numbers and scores of each query's k best of ``rows``, ties by id; both are of length one."""
    scores = np.round(queries @ rows.T, DIGITS)
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        q, r = np.nonzero(scores >= least)  # with all that equal the k-th
    else:
        q, r = np.nonzero(np.ones(scores.shape, bool))
    order = np.lexsort((ids[r], -scores[q, r], q))
    q, r = q[order], r[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], r[place < k], scores[q, r][place < k]


@dataclass(frozen=True)
class Vectors:
    """``cells(cell, id, embedding)`` by cell; ``pivots`` are unit rows, ``radius`` angles and ``count`` vectors of cells 0, 1, ...; cell -1 has zero vectors."""

    spark: SparkSession
    path: str
    id_col: str
    id_type: str
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    zeros: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"`{self.id_col}` {self.id_type}, embedding array<double>, cell int").parquet(self.path)

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """The largest cosine that each query can have with a vector of each cell, then of the cell of zero vectors."""
        angle = np.arccos(np.clip(queries @ self.pivots.T, -1, 1)) - self.radius
        top = np.cos(np.clip(angle, 0, np.pi)) + 1e-9
        top[~queries.any(axis=1)] = 1.0
        return np.hstack([top, np.full((len(queries), 1), 0.0 if self.zeros else -2.0)])


def store(vectors: DataFrame, id_col: str, vector_col: str, path: str, cell: int = CELL) -> Vectors:
    """Write the vectors by cells.  Null vectors are left out; lengths must agree; pivots are fitted on a bounded sample."""
    spark = vectors.sparkSession
    kept = vectors.where(F.col(vector_col).isNotNull()).select(id_col, F.col(vector_col).cast("array<double>").alias("embedding"))
    kept = scratch.written(kept, "vectors")
    n = kept.count()
    k = max(1, min(MOST_CELLS, n // cell))
    some = kept.orderBy(F.xxhash64(id_col), id_col).limit(min(SAMPLE, 64 * k)).select("embedding").toArrow()
    sample = unit(matrix(some.column(0).combine_chunks()))
    sample = sample[sample.any(axis=1)] if len(sample) else sample
    pivots = sample[np.random.default_rng(1).choice(len(sample), min(k, len(sample)), replace=False)] if len(sample) else np.zeros((0, 1))
    for _ in range(8 if len(pivots) else 0):
        near = (sample @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        pivots = np.where(sums.any(axis=1, keepdims=True), unit(sums), pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit(matrix(batch.column(1)))
            near = rows @ pivots.T if len(pivots) and len(rows) else np.zeros((len(rows), 1))
            at = np.where(rows.any(axis=1) if len(rows) else np.zeros(0, bool), near.argmax(axis=1), -1)
            angle = np.arccos(np.clip(near.max(axis=1), -1, 1)) if len(rows) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(angle)], names=[id_col, "embedding", "cell", "angle"])

    id_type = vectors.schema[id_col].dataType.simpleString()
    placed = scratch.written(kept.mapInArrow(place, f"`{id_col}` {id_type}, embedding array<double>, cell int, angle double"), "placed-vectors")
    files = max(1, n // (64 * cell))
    placed.drop("angle").repartition(files, "cell", F.pmod(F.xxhash64(id_col), F.lit(8))).write.partitionBy("cell").parquet(path)
    facts = {r.cell: r for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}  # a row a cell
    told = lambda c, name: facts[c][name] if c in facts else 0
    cells = range(len(pivots))
    return Vectors(spark, path, id_col, id_type, pivots, np.array([told(c, "radius") for c in cells], float), np.array([told(c, "n") for c in cells], int), told(-1, "n"))


def _compared(held: Vectors, rows: DataFrame, queries: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
    """``(q, id, score)``: the k best of each query number in each batch of the cells that ``wanted`` names for it."""
    cells = [c if c < len(held.pivots) else -1 for c in np.flatnonzero(wanted.any(axis=0)).tolist()]
    sent = held.spark.sparkContext.broadcast((queries, wanted))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted = sent.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(cell).tolist():
                at, who = np.flatnonzero(cell == c), np.flatnonzero(wanted[:, c])
                q, r, s = best(queries[who], unit(matrix(batch.column(1).take(pa.array(at)))), ids[at], k)
                yield pa.RecordBatch.from_arrays([pa.array(who[q]), batch.column(0).take(pa.array(at[r])), pa.array(s)], names=["q", "id", "score"])

    return rows.where(F.col("cell").isin(cells)).mapInArrow(score, f"q long, id {held.id_type}, score double")


def nearest(held: Vectors, queries: DataFrame, k: int, vector_col: str = "embedding", within: DataFrame | None = None, told: list[float] | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: the k nearest vectors of each row of ``queries(query_id, embedding)`` by cosine; ties by id; exact.

    Queries go in blocks of checked bytes, each with two passes over the cells that it needs.  ``within(id)`` limits what is found.
    Zero vectors have the cosine 0, null queries are left out.  ``told`` gets the share of all vectors that each block compared.
    """
    spark = held.spark
    rows = held.rows if within is None else held.rows.join(within.select(held.id_col).distinct(), held.id_col, "left_semi").select(held.id_col, "embedding", "cell")
    asked = queries.where(F.col(vector_col).isNotNull()).select("query_id", F.col(vector_col).cast("array<double>").alias("v"))
    size = asked.agg(F.count("*"), F.sum(F.size("v"))).first()
    blocks = max(1, -(-8 * (size[1] or 0) // BLOCK_BYTES))
    total, parts = int(held.count.sum()) + held.zeros, []
    for block in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if not table.num_rows or not total:
            continue
        q = unit(matrix(table.column("v").combine_chunks()))
        if len(held.pivots) and q.shape[1] != held.pivots.shape[1]:
            raise ValueError("query and document vectors differ in their dimensions")
        reach, many = held.reach(q) if len(held.pivots) else np.zeros((len(q), 1)), np.append(held.count, held.zeros)
        order = np.argsort(-reach, axis=1, kind="stable")
        before = np.cumsum(many[order], axis=1) - many[order]
        first = np.zeros(reach.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        one = scratch.written(_compared(held, rows, q, first, k), "first-neighbours")
        kth = one.withColumn("p", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("p") == k).select("q", "score").toArrow()
        bound = np.full(len(q), -2.0)
        bound[kth.column("q").to_numpy()] = kth.column("score").to_numpy()
        more = (reach >= bound[:, None] - SLACK) & ~first & (many > 0)
        if told is not None:
            told.append(float(((first | more) * many).sum() / (len(q) * total)))
        found = one.unionByName(_compared(held, rows, q, more, k)) if more.any() else one
        names = spark.createDataFrame(pa.table({"q": pa.array(range(table.num_rows), pa.int64()), "query_id": table.column("query_id")}))
        parts.append(found.join(names, "q").drop("q"))
    if not parts:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {held.id_type}, score double, rank long")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return every.select("query_id", "id", "score").withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def stored(spark: SparkSession, name: str, source: Callable[[], tuple[DataFrame, str, str]]) -> Vectors:
    """The application's vectors of this name, stored at their first use and again when the files of their table have changed."""
    key = (spark.sparkContext.applicationId, name)
    vectors, id_col, vector_col = source()
    state = _state_of(vectors)
    if key not in _stored or _stored[key][0] != state:
        _stored[key] = state, store(vectors, id_col, vector_col, scratch.shared_folder(spark, "cells"))
    return replace(_stored[key][1], spark=spark)


def forget(spark: SparkSession) -> None:
    """Drop the application's vectors from the list of what is stored."""
    for key in [k for k in _stored if k[0] == spark.sparkContext.applicationId]:
        del _stored[key]
