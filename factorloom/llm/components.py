"""Connected components of an edge table, by least labels with pointer jumping.

Labels spread over edges with a partial minimum for each node before the shuffle, then each
label is replaced by its own label, which halves the depth of chains. Each round is written
to the shared folder; nothing but a count of changes reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import discard, materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of edges(a long, b long); nodes without an
    edge do not occur. Raises if labels still change after max_rounds."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        spread = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("of_b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("heard"))
        heard = labels.join(spread, "node").select("node", F.col("component").alias("before"), F.least("component", "heard").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("of_c"))
        after = materialize(heard.join(jump, "c").select("node", F.least("c", "of_c").alias("component"), (F.least("c", "of_c") != F.col("before")).alias("changed")), "labels")
        discard(labels)  # the round before
        labels = after.select("node", "component")
        if after.where("changed").limit(1).count() == 0:
            discard(both)
            return labels
    raise RuntimeError(f"components still change after {max_rounds} rounds")
