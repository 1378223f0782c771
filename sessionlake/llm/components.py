"""Connected components by hooking of minimum labels and pointer jumping, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import released, written


def components(edges: DataFrame) -> DataFrame:
    """v, label for every end of an edge (a, b): label is the smallest vertex reachable.

    A round takes, for every vertex, the least label of its neighbours' labels,
    and writes it onto the vertex and onto the vertex that its label names, so
    that whole trees are hooked at once and their depth halves (FastSV). Labels
    only fall, so the rounds end; each is written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = table = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        above = labels.join(jump, "label").select("v", "label", "next")
        near = both.join(above.select(F.col("v").alias("b"), "next"), "b").groupBy(F.col("a").alias("v")).agg(F.min("next").alias("near"))
        low = written(above.join(near, "v").select("v", "label", F.least("label", "next", "near").alias("low")), "cc-near")
        hooks = low.groupBy(F.col("label").alias("v")).agg(F.min("low").alias("hook"))
        after = low.join(hooks, "v", "left").select("v", F.least("low", "hook").alias("label"), (F.least("low", "hook") < F.col("label")).alias("moved"))
        after = written(after, "cc-labels")
        released(table, low)
        labels, table = after.select("v", "label"), after
        if after.filter("moved").isEmpty():
            released(both)
            return labels
