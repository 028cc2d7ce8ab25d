"""Connected components by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that is reachable.

    Each round every node takes the smallest label among its own, its neighbours' and its label's label, so the
    number of rounds follows the logarithm of the longest path. Messages are summed up before the shuffle. Each
    round's labels are written to the shared folder. Nothing comes to the driver but the number of changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:  # each round but the last makes a label smaller
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("m"))
        jumped = labels.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        new = labels.join(heard, labels.node == heard.a).join(jumped, F.col("comp") == F.col("up"), "left")
        new = stored(new.select("node", F.least("comp", "m", "top").alias("comp"), (F.least("comp", "m", "top") < F.col("comp")).alias("changed")), "labels")
        labels = new.select("node", "comp")
        if new.where("changed").isEmpty():
            return labels
