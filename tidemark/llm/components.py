"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._frames import cut, drop_tables


def components(links: DataFrame) -> DataFrame:
    """(v, label) for the vertices of links (a, b): the least vertex that each can reach.

    A round takes the least label of all neighbours and then the label's own label, so chains
    shorten by more than half a round.  Each round is written to the shared folder; only a count of changes
    comes back.  The aggregations are partial before their shuffle, so a hub is no bottleneck.
    """
    both = links.where("a <> b").select("a", "b")
    both = cut(both.union(both.select("b", "a")).distinct(), "links")
    at = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "labels")
    while True:
        seen = both.join(at, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("m"))
        step = at.join(seen, F.col("v") == F.col("a")).select("v", "label", F.least("label", "m").alias("m"))
        up = at.select(F.col("v").alias("u"), F.col("label").alias("jump"))
        step = step.join(up, F.col("m") == F.col("u"), "left").select("v", "label", F.least("m", F.coalesce("jump", "m")).alias("m"))
        step = cut(step, "labels")
        done = step.where("m <> label").isEmpty()
        if done:
            drop_tables(links.sparkSession, both, step)
            return at
        drop_tables(links.sparkSession, at)
        at = step.select("v", F.col("m").alias("label"))
