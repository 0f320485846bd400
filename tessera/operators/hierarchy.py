"""Parent-child rows of unknown depth -> path, depth, root and descendants, with loops named.

Pointer doubling: every round each open node jumps to where its target already points, so depth d is
resolved after about log2(d) rounds.  A round that resolves nothing proves that no open node can reach
a root any more (a node of depth d has ancestors of every smaller depth), so the rest leads into loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize


def name_key(c: Column) -> Column:
    """Form in which two spellings of one name agree: case, outer blanks and the sign between words."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$", "")), "[^\\p{L}\\p{M}\\p{N}]+", "_")


def resolve_parents(df: DataFrame, node: str, parent: str) -> DataFrame:
    """Distinct (node, parent) rows in which ``parent`` is the node id meant, or null for roots.

    Null node ids are dropped.  Of several rows of one node the smallest resolvable parent counts; of
    several nodes with one key the smallest id is meant.
    """
    rows = df.select(F.col(f"`{node}`").cast("string").alias("node"), F.col(f"`{parent}`").cast("string").alias("named")).where("node is not null")
    names = rows.groupBy(name_key(F.col("node")).alias("key")).agg(F.min("node").alias("parent"))
    linked = rows.withColumn("key", F.nullif(name_key(F.col("named")), F.lit(""))).join(names, "key", "left")
    return linked.groupBy("node").agg(F.min("parent").alias("parent"))


def hierarchy(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth, path): one row per distinct node.

    ``path`` runs from the root to the node.  A node on a loop has depth -1, a node whose parents lead
    into a loop -2; for both ``root`` is the smallest id on that loop and ``path`` is null.  A node
    that names itself as parent is a loop of one.  An empty table gives an empty table.
    """
    links = resolve_parents(df, node, parent)
    state = materialize(
        links.select(
            "node",
            F.coalesce("parent", "node").alias("ptr"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).alias("dist"),
            F.array("node").alias("path"),
            F.col("node").alias("low"),
            F.col("parent").isNull().alias("done"),
        ),
        "hierarchy",
    )
    open_rows = state.where("not done").count()
    while open_rows:
        far = state.select(*[F.col(c).alias(f"t_{c}") for c in ("node", "ptr", "dist", "path", "low", "done")])
        moved = state.where("not done").join(far, F.col("ptr") == F.col("t_node")).select(
            "node",
            F.col("t_ptr").alias("ptr"),
            (F.col("dist") + F.col("t_dist")).alias("dist"),
            F.when(F.col("t_done") & (F.col("t_dist") == 0), F.concat("path", F.array("t_node"))).otherwise(F.concat("path", "t_path")).alias("path"),
            F.least("low", "t_low").alias("low"),
            F.col("t_done").alias("done"),
        )
        state = materialize(state.where("done").unionByName(moved), "hierarchy")
        left = state.where("not done").count()
        if left == open_rows:
            break
        open_rows = left
    solved = state.where("done").select("node", F.col("ptr").alias("root"), "dist", "path")
    trees = solved.select("node", "root", F.col("dist").alias("depth"), F.reverse("path").alias("path"))
    if not open_rows:
        return trees
    return trees.unionByName(_loops(state.where("not done").select("node", "ptr", "low")))


def _loops(rest: DataFrame) -> DataFrame:
    """Nodes that never reach a root.  The images of ever longer jumps shrink to the loops; they are
    the loops once a doubled jump has as many images and the smallest id seen no longer changes."""
    state = rest
    while True:
        far = state.select(*[F.col(c).alias(f"t_{c}") for c in ("node", "ptr", "low")])
        images = state.select(F.col("ptr").alias("image")).distinct()
        joined = state.join(far, F.col("ptr") == F.col("t_node")).join(images, F.col("node") == F.col("image"), "left")
        moved = materialize(
            joined.select(
                "node",
                F.col("t_ptr").alias("ptr"),
                F.least("low", "t_low").alias("low"),
                F.col("image").isNotNull().alias("was_image"),
                (F.col("image").isNotNull() & (F.col("t_low") < F.col("low"))).alias("lowered"),
            ),
            "loops",
        )
        before, lowered = moved.agg(F.count_if("was_image"), F.count_if("lowered")).first()
        after = moved.select("ptr").distinct().count()
        if before == after and not lowered:
            lows = moved.where("was_image").select(F.col("node").alias("landing"), F.col("low").alias("root"))
            return moved.join(lows, F.col("ptr") == F.col("landing")).select(
                "node", "root", F.when(F.col("was_image"), -1).otherwise(-2).alias("depth"), F.lit(None).cast("array<string>").alias("path")
            )
        state = moved.select("node", "ptr", "low")


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every pair above and below each other in ``hierarchy``'s
    result; as many rows as the depths add up to.  Nodes at loops have none."""
    pairs = tree.where("depth > 0").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("level", "ancestor"))
    return pairs.where("level < depth").select("ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))
