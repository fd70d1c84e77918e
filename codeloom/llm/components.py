"""Connected components by alternating large-star and small-star joins (Kiveris et al., 2014)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import remove, shared_dir


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger id (u) to the smaller one (v); self-loops and nulls go."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _star_round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # large star: every larger neighbour hangs on the least neighbour
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # small star: the smaller neighbours and the node itself hang on the least one
    small = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(small, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) -> (id, root): each node that has an edge, with the least id it can reach.

    Ids are longs. Rounds run until the edge set stays as it is, O(log n) of them; each is written to the shared
    folder, so lineage stays short, and the one before is removed. A hub's rows are two longs each; the join on it sorts and
    spills, and is split when its partition grows past what adaptive execution takes for skew. Edges with a null end and self-loops link nothing. An empty table gives
    an empty result.
    """
    spark, seen, current, path = edges.sparkSession, None, None, None
    for _ in range(max_rounds):
        last, path = path, f"{shared_dir(edges.sparkSession)}/components-{uuid4().hex}"
        (_oriented(edges) if current is None else _star_round(current)).write.parquet(path)
        current = spark.read.schema("u long, v long").parquet(path)
        if last:
            remove(spark, last)
        now = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if now == seen or not now["n"]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("id")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))
