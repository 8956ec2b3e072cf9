"""Connected components of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import keep


def components(links: DataFrame, broadcast: int = 0) -> DataFrame:
    """(id, label): the least id reachable over links (a, b).  Each round every node takes the
    least label around it and then that label's own label, so stars settle in two rounds and
    chains in a number of rounds that follows the logarithm of their length.

    Up to ``broadcast`` labels are sent to every task, which leaves one exchange a round; a label's own label
    is then that of the round before, as no exchange brings the new one."""
    both = keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    few = broadcast > 0 and labels.count() <= broadcast
    while True:
        if few:
            at = F.broadcast(labels).alias("at")
            near = both.join(at, F.col("b") == F.col("at.id")).groupBy("a").agg(F.min("at.label").alias("near"))
            step = near.join(at, F.col("a") == F.col("at.id")).select("a", F.col("at.label").alias("was"), F.least("at.label", "near").alias("now"))
            new = step.join(at, F.col("now") == F.col("at.id")).select(F.col("a").alias("id"), "was", F.least("now", "at.label").alias("label"))
        else:
            near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
            step = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
            jump = step.select(F.col("id").alias("j_id"), F.col("label").alias("j_label"))
            new = step.join(jump, step.label == jump.j_id).select("id", "was", F.least("label", "j_label").alias("label"))
        new = keep(new, "labels")
        if new.filter("was <> label").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")
