"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.runtime import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each component, for every node of an edge.

    Labels spread along edges and then jump to their label's label, so rounds follow the
    logarithm of a component's length.  Lineage is cut by a reliable checkpoint each round;
    labels never reach the driver.  Self-loops and repeated edges do no harm; edges with a null
    end are dropped; no edges give no rows.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    links = cut(both.select(F.col(a).alias("u"), F.col(b).alias("v")).union(both.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = cut(links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        heard = links.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("heard"))
        step = labels.join(heard, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("heard", "component")).alias("now"))
        jump = step.join(step.select(F.col("node").alias("now"), F.col("now").alias("top")), "now", "left").select("node", "was", F.least("now", F.coalesce("top", "now")).alias("component"))
        moved = cut(jump)
        labels = moved.select("node", "component")
        if moved.where("was <> component").limit(1).count() == 0:
            return labels
