"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum, a join back and a distinct; no neighbour list is ever collected.
Every round is written to the checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, root)``: each node with an edge and the least node it reaches.

    Loops (a = b), repeated and reversed edges are allowed; rows with a null are ignored.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        seen = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
