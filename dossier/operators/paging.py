"""Pages of a stored result: a snapshot in order with a directory, and tokens that are bound to it.

Rows lie in files by ranges of (axis, order).  The manifest, published last, tells for each file how many rows of each
axis it holds and how many of the axis lie before it, so a page reads the one or two files that it is in and totals
are looked up.  A token names revision, query, page size, axis and offset; one that does not fit is refused.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier import scratch

#: Rows of a file, and the largest page; the page bound is a fixed value.
ROWS_PER_FILE, LARGEST = 20_000, 500


@dataclass(frozen=True)
class Pages:
    """``order`` are columns, descending if they begin with "-"; ``parts`` are (axis, file, rows of the axis before it, rows in it)."""

    spark: SparkSession
    path: str
    revision: str
    query: str
    axis: str
    order: list[str]
    parts: list[tuple]

    def total(self, axis) -> int:
        return sum(n for a, _, _, n in self.parts if a == axis)

    def axes(self) -> list:
        return list(dict.fromkeys(a for a, *_ in self.parts))

    def read(self, offsets: dict, size: int) -> DataFrame:
        """Rows ``offset`` to ``offset + size`` of each axis of ``offsets``, with ``place`` from 1, ``total`` of the axis and ``remaining`` after the page."""
        if not 1 <= size <= LARGEST:
            raise ValueError(f"a page has 1 to {LARGEST} rows")
        wanted = [(a, f, before) for a, f, before, n in self.parts if a in offsets and before < offsets[a] + size and before + n > offsets[a]]
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        files = sorted({f for _, f, _ in wanted})
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/rows/{f}" for f in files)) if files else self.spark.createDataFrame([], schema)
        told = {a: (offsets[a], min(b for x, _, b in wanted if x == a), self.total(a)) for a, _, _ in wanted}
        mine: Column = F.lit(False)
        for a in told:
            mine = mine | F.col(self.axis).eqNullSafe(F.lit(a)) & (F.col("_metadata.file_name").isin([f for x, f, _ in wanted if x == a]) if files else F.lit(True))
        fact = lambda k: F.coalesce(*(F.when(F.col(self.axis).eqNullSafe(F.lit(a)), F.lit(v[k])) for a, v in told.items()), F.lit(0)).cast("long")
        place = F.row_number().over(Window.partitionBy(self.axis).orderBy(*_order(self.order))) + fact(1)  # of the rows of a few files
        placed = rows.where(mine).withColumn("place", place.cast("long")).where((F.col("place") > fact(0)) & (F.col("place") <= fact(0) + size))
        return placed.withColumns({"total": fact(2), "remaining": F.greatest(fact(2) - fact(0) - size, F.lit(0)).cast("long")})

    def token(self, axis, size: int, offset: int = 0) -> str:
        held = json.dumps({"axis": axis, "offset": offset, "query": self.query, "revision": self.revision, "size": size}, sort_keys=True, separators=(",", ":"))
        return base64.urlsafe_b64encode(held.encode()).decode()

    def page(self, token: str) -> tuple[DataFrame, str | None]:
        """The page that ``token`` names, and the token of the next one if there is one; ``ValueError`` if it is none of this result."""
        try:
            held = json.loads(base64.urlsafe_b64decode(token.encode()))
            axis, offset, size = held["axis"], held["offset"], held["size"]
            sound = token == self.token(axis, size, offset) and type(offset) is int and type(size) is int and 0 <= offset <= self.total(axis)
        except (ValueError, TypeError, KeyError):
            sound = False
        if not sound:
            raise ValueError("the token does not fit this result")
        after = offset + size
        return self.read({axis: offset}, size), self.token(axis, size, after) if after < self.total(axis) else None


def _order(order: list[str]) -> list[Column]:
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first() for c in order]


def store(rows: DataFrame, axis: str, order: list[str], path: str, query: str = "", rows_per_file: int = ROWS_PER_FILE) -> Pages:
    """Write a result once; ``order`` must tell rows of an axis apart.  Axes are few (the manifest lists them for each file).

    The revision is a hash of the rows whatever their order; a path that holds a result is an error.
    """
    spark = rows.sparkSession
    kept = scratch.written(rows, "result-rows")
    columns = sorted(kept.columns)
    count, xored, summed = kept.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)), F.coalesce(F.sum(F.xxhash64(F.lit("sum"), *columns).cast("decimal(38,0)")), F.lit(0))).first()
    revision = hashlib.sha256(f"{columns}|{count}|{xored}|{summed}".encode()).hexdigest()[:16]
    keys = [F.col(axis).asc_nulls_first(), *_order(order)]
    laid = kept.repartitionByRange(max(1, math.ceil(count / rows_per_file)), *keys).sortWithinPartitions(*keys)
    laid.write.mode("error").option("maxRecordsPerFile", 2 * rows_per_file).parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("file"), axis).count().collect()  # a row a file and axis
    before: dict = {}
    parts = []
    for r in sorted(held, key=lambda r: r.file):  # files are named in the order of their ranges
        parts.append((r[axis], r.file, before.get(r[axis], 0), r["count"]))
        before[r[axis]] = before.get(r[axis], 0) + r["count"]
    told = {"revision": revision, "query": query, "axis": axis, "order": order, "parts": parts}
    scratch.publish_text(spark, f"{path}/manifest.json", json.dumps(told))
    return Pages(spark, path, revision, query, axis, order, parts)


def opened(spark: SparkSession, path: str) -> Pages:
    """The result stored at ``path``."""
    held = json.loads(scratch.read_text(spark, f"{path}/manifest.json"))
    return Pages(spark, path, held["revision"], held["query"], held["axis"], held["order"], [tuple(p) for p in held["parts"]])
