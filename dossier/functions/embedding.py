"""A user's embedding model over a column of texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], "np.ndarray"]


def embed(text: Column, make: Callable[[], Embedder], size: int, prefix: str = "") -> Column:
    """Vectors of ``size`` floats from the embedder that ``make`` returns, made once for each worker.

    ``prefix`` goes before every text (models that tell passages from queries).  A wrong number of
    vectors or of dimensions is an error; null texts are embedded as empty.
    """
    own: list[Embedder] = []

    @F.arrow_udf("array<float>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not own:
            own.append(make())
        for texts in batches:
            listed = [prefix + (t or "") for t in texts.to_pylist()]
            vectors = np.asarray(own[0](listed), np.float32)
            if vectors.shape != (len(listed), size):
                raise ValueError(f"the embedder gave {vectors.shape} for {len(listed)} texts of {size} dimensions")
            yield pa.array(list(vectors), pa.list_(pa.float32()))

    return udf(text)


def build_vectors(rows: DataFrame, id_col: str, text_col: str, make: Callable[[], Embedder], size: int, model: str) -> DataFrame:
    """``(id, embedding, model, dims, text_hash)``: the hash tells later whether a vector is stale."""
    return rows.select(id_col, embed(F.col(text_col), make, size).alias("embedding"), F.lit(model).alias("model"), F.lit(size).cast("long").alias("dims"), F.sha2(text_col, 256).alias("text_hash"))


def stale_vectors(vectors: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids whose vector is missing, or was made from another text or is of no row any more."""
    now = rows.select(id_col, F.sha2(text_col, 256).alias("now"))
    joined = vectors.select(id_col, "text_hash").join(now, id_col, "full_outer")
    fault = F.when(F.col("text_hash").isNull(), "missing").when(F.col("now").isNull(), "orphan").when(F.col("now") != F.col("text_hash"), "stale")
    return joined.select(id_col, fault.alias("fault")).where("fault is not null")
