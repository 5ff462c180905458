"""Trees and forests given as rows that name their parent.

Ways to the top are found by pointer doubling: each step joins every row that isn't at the top yet with the row it points
to, so a tree of depth n takes log2(n) joins, whatever its shape, and no depth is too much. Rows that the top doesn't
reach (a parent that is missing, a cycle) are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage


def ways_to_top(nodes: DataFrame, group: str, node: str, parent: str, ord: str, value: str | None = None) -> DataFrame:
    """group, node, path (the ordinals from the top down), depth, and for `value` the nearest value that isn't null on the way up (own first) as `inherited`.

    nodes has one row per (group, node); a null parent is the top.
    """
    own = F.col(value) if value else F.lit(None)
    d = nodes.select(group, node, F.col(parent).alias("_up"), F.array(F.col(ord).cast("int")).alias("path"), own.alias("inherited"))
    d = cut_lineage(d)
    size, steps = d.count(), 0
    while 2**steps <= 2 * size:  # a way has at most as many nodes as there are
        above = d.select(group, F.col(node).alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_path"), F.col("inherited").alias("_value"))
        # tops pass by; only rows that still point somewhere are joined
        open_rows = d.where(F.col("_up").isNotNull())
        if open_rows.isEmpty():
            break
        moved = open_rows.join(above, [group, "_up"]).select(group, node, F.col("_next").alias("_up"), F.concat("_path", "path").alias("path"), F.coalesce("inherited", "_value").alias("inherited"))
        d = cut_lineage(d.where(F.col("_up").isNull()).unionByName(moved))
        steps += 1
    d = d.where(F.col("_up").isNull())
    return d.select(group, node, "path", (F.size("path") - 1).alias("depth"), "inherited")


def subtree_counts(ways: DataFrame, group: str, node: str) -> DataFrame:
    """group, node, below: how many nodes stand below each, from the ways to the top: every node counts once for each prefix of its path."""
    prefixes = ways.where("depth > 0").select(group, F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> slice(path, 1, i))")).alias("path"))
    below = prefixes.groupBy(group, "path").agg(F.count(F.lit(1)).alias("below"))
    return ways.select(group, node, "path").join(below, [group, "path"], "left").select(group, node, F.coalesce("below", F.lit(0)).alias("below"))
