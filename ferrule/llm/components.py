"""Connected components of an edge table, by alternating star contraction.

Each step replaces the edges of a node by edges to its smallest neighbour, first
for the larger neighbours, then for the smaller; the graph becomes a forest of
stars whose centres are the smallest ids.  Every step is grouped aggregation
and joins, written to a shared folder; nothing is collected but its row count and
checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, stored_at

#: Parts of the edges that lead to one node, so that the centre of a large star is no hot key.
SALTS = 16


def _larger_to_least(edges: DataFrame) -> DataFrame:
    """Every edge (a, b), a > b, led on to the smallest neighbour of b, where that is smaller than b."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_w"), "_m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_k"))
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    # Spread over the salts the table is many times its estimated size, so it is never broadcast.
    led = salted.join(least.hint("merge"), (F.col("b") == F.col("_w")) & (F.col("_s") == F.col("_k")), "left")
    return led.select("a", F.coalesce("_m", "b").alias("b")).distinct()


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """For every a, edges from it and from its other smaller neighbours to the smallest one.

    A node has few smaller neighbours: one at most for each star that it was dealt to.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_w"), "_m")
    others = edges.join(least, F.col("a") == F.col("_w")).where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return others.unionByName(least.select(F.col("_w").alias("a"), F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); component is the smallest id of its component."""
    spark = edges.sparkSession
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    (current, path), before = stored_at(ordered, "edges"), None
    while True:
        # The edges of the last step are read no more once those of the next are written.
        last, (current, path) = path, stored_at(_smaller_to_least(_larger_to_least(current)), "edges")
        discard(spark, last)
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
