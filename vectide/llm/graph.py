"""Connected components by label exchange with pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one orderable type. Returns node, root: the least node that each can reach.

    Each round a node takes the least label among itself and its neighbours, then that label's own
    label, so labels travel distances that double. Rounds are written to the shared folder.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(seen, "node").select("node", "root", F.least("root", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("root").alias("far"))
        new = saved(step.join(jump, "near").select("node", F.least("near", "far").alias("root"), (F.least("near", "far") != F.col("root")).alias("moved")))
        labels = new.select("node", "root")
        if new.filter("moved").isEmpty():
            return labels
