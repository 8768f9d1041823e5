"""Connected components of a distributed edge list, without collecting links, labels or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.store import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every vertex of ``edges`` (u, v: longs, undirected): c is the smallest vertex it reaches.

    Rounds of least neighbour labels and pointer jumping; each is written to the shared folder. Hot labels and
    hubs meet in partial minima and in joins that adaptive execution may split.
    """
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u != v").distinct(), "edges")
    if both.isEmpty():
        return both.select(F.col("u").alias("v"), F.col("v").alias("c"))
    label = written(both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("c")), "labels")
    while True:
        near = both.join(label, "v").groupBy(F.col("u").alias("v")).agg(F.min("c").alias("n"))
        hooked = label.join(near, "v", "left").select("v", "c", F.least("c", "n").alias("n"))
        # a root takes the least label that any of its members saw
        roots = hooked.groupBy("c").agg(F.min("n").alias("r"))
        step = written(hooked.join(roots, "c").select("v", F.least("n", "r").alias("c"), F.col("c").alias("old")), "labels")
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("far"))
        after = written(step.join(jump, "c", "left").select("v", F.least("c", "far").alias("c"), "old"), "labels")
        changed = after.where("c != old").limit(1).count()
        dropped(label)
        dropped(step)
        label = after.select("v", "c")
        label._scratch_path = after._scratch_path
        if not changed:
            dropped(both)
            return label


def merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """``label`` (v, c) as ``components`` gave it, with further edges (u, v): only those between different components are worked on."""
    of = lambda name: label.select(F.col("v").alias(name), F.col("c").alias(f"{name}_label"))
    ends = edges.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left")
    between = written(ends.select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v")).where("u != v").distinct(), "between")
    if not between.limit(1).count():
        dropped(between)
        return label
    more = components(between)
    joined = label.join(more.select(F.col("v").alias("c"), F.col("c").alias("least")), "c", "left").select("v", F.coalesce("least", "c").alias("c"))
    out = written(joined.union(more.join(label.select("v"), "v", "left_anti").select("v", "c")), "labels")
    for table in (between, more, label):
        dropped(table)
    return out
