"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marlstone.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every linked node; the root is the least node of its component.

    Minimum labels travel along the links, and every node then takes the label of its label, so
    the number of rounds grows with the logarithm of a component's diameter in the usual case.
    Each round is a written table. Null ends make no link; no links give no rows.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    edges = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = edges.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("root"))
    while True:
        heard = edges.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = nearer.join(above, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root"))
        seen = Observation("components")
        labels = cut(step.observe(seen, F.count_if(F.col("root") < F.col("old")).alias("changed")).select("node", "root"), "roots")
        if not seen.get["changed"]:
            return labels
