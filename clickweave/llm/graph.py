"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.llm.shared import materialized


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Rows node, label for every node of an edge (columns a, b); the label is the smallest node of its component.

    Large-star and small-star in turn: every node tells its larger neighbours of the smallest one it knows, then
    every node hands its smaller neighbours to their smallest. The number of rounds grows with the logarithm of a component's
    size. Only the count of edges that changed reaches the driver; each round is written out, so none is done twice.
    """
    current = materialized(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))) \
            .where(F.col("a") != F.col("b")).distinct()
        after = materialized(small, "edges")
        n_before, n_after = current.count(), after.count()
        if n_before == n_after and after.join(current, ["a", "b"], "left_anti").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("label")) \
                .union(after.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        current = after
    raise RuntimeError("components did not settle")
