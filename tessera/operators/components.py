"""Connected components without collecting links: hooking to smaller roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every linked node with the smallest node of its component.

    Each round hooks every root to its smallest neighbouring root, flattens the chains by pointer
    jumping and contracts the links, so the number of rounds grows with the logarithm of the largest
    component.  Links to itself or with null are ignored; no links give an empty table.
    """
    edges = materialize(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "edges")
    labels: DataFrame | None = None
    while True:
        hooks = materialize(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = materialize(hooks.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "jumps")
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            labels = materialize(moved.unionByName(hooks.join(labels, "node", "left_anti")), "labels")
        ends = hooks.select("node", "root")
        left = edges.join(ends.withColumnsRenamed({"node": "lo", "root": "lo_root"}), "lo", "left").join(ends.withColumnsRenamed({"node": "hi", "root": "hi_root"}), "hi", "left")
        x, y = F.coalesce("lo_root", "lo"), F.coalesce("hi_root", "hi")
        edges = materialize(left.select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).where("lo < hi").distinct(), "edges")
        if edges.isEmpty():
            roots = labels.select("root").distinct().select(F.col("root").alias("node"), "root")
            return labels.unionByName(roots).groupBy("node").agg(F.min("root").alias("root"))
