"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Edges that a task of a stored table holds on average; rounds of few edges so need few tasks.
TASK_EDGES = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Each round rewires edges to smaller neighbours: large-star links every larger neighbour of a node to the
    smallest one, small-star does the same for the smaller neighbours. Rows never outnumber the distinct edges
    that came in; the minimum per node is combined before the shuffle, so a node with many neighbours is safe,
    and its join side is a single row that the other, splittable side meets. The rounds end when the edges form
    stars. Null ends and self-loops are dropped.
    """
    current = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == state:
            break
        before = state
        tasks = max(1, state[0] // TASK_EDGES)
        current = current.coalesce(tasks)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        current = cut(small.select("e.*").where("a <> b").distinct(), tasks)
    return current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
