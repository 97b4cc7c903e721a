"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut as written


def cut(df: DataFrame) -> DataFrame:
    """``df`` written, without its plan's estimate of size: the product of those of a join, whose digits double in every round."""
    df, spark = written(df), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b) reaches.

    Labels spread to neighbours and to the node they name, and then jump to their label's label, so the rounds are logarithmic in the
    length of paths; every round is written, and all groupings are partial minima.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = cut(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was")))
        # the node of a label learns the least label that any of its followers saw: whole groups join, not only their rims
        told = step.groupBy(F.col("was").alias("node")).agg(F.min("component").alias("told"))
        step = cut(step.join(told, "node", "left").select("node", F.least("component", "told").alias("component"), "was"))
        jump = step.select(F.col("node").alias("_at"), F.col("component").alias("_to"))
        after = cut(step.join(jump, step["component"] == jump["_at"]).select("node", F.least("component", "_to").alias("component"), "was"))
        if after.where("component <> was").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
