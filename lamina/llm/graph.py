"""Connected groups of a graph given as edges, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import forget, keep


def groups(edges: DataFrame) -> DataFrame:
    """(id, root): every end of an edge with the smallest id of its connected group.

    ``edges`` has columns ``a`` and ``b`` of any one ordered type; direction, repeats and loops do not matter.
    Every round links each node to the smallest root next to it and halves the paths to the roots; no round
    gathers the neighbours of a node, so a hub costs no more than its edges.
    """
    both = keep(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = keep(both.groupBy("a").agg(F.min("b").alias("near")).select(
        F.col("a").alias("id"), F.least("a", "near").alias("root")), "roots")
    while True:
        of = roots.select(F.col("id").alias("b"), F.col("root").alias("next"))
        near = both.join(of, "b").groupBy("a").agg(F.min("next").alias("near"))
        # A root takes over the smallest root that any of its members sees.
        linked = roots.join(near.withColumnRenamed("a", "id"), "id").select("id", "root", F.least("root", "near").alias("near"))
        best = linked.groupBy("root").agg(F.min("near").alias("best"))
        moved = linked.join(best, "root").select("id", F.least("near", "best").alias("root"), F.col("root").alias("old"))
        # Follow the new root one step on.
        step = moved
        after = step.select(F.col("id").alias("root"), F.col("root").alias("top"))
        jumped = keep(step.join(after, "root", "left").select("id", F.coalesce("top", "root").alias("root"), "old"), "roots")
        changed = jumped.where(F.col("root") != F.col("old")).limit(1).count()
        forget(roots)
        roots = jumped.select("id", "root")
        if not changed:
            forget(both)
            return roots
