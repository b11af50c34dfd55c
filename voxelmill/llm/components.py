"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._shared import discard, join_counted, settle

#: A node of at most so many edges is one task's: 32 MB of two longs each. Of more edges than that in
#: all, the ones of frequent nodes are joined apart.
HUB_ROWS = 1_000_000


def _stars(edges: DataFrame, both_ways: bool, total: int, hub_rows: int) -> DataFrame:
    """Hang the neighbours of each node on the least of them. The least neighbour is a partial
    aggregate and comes back by a join, so a node with very many edges is never gathered.
    ``total``: no fewer than the edges."""
    around = edges.select(F.col("u").alias("n"), F.col("v").alias("w"))
    if both_ways:
        around = around.union(edges.select(F.col("v").alias("n"), F.col("u").alias("w")))
    least = around.groupBy("n").agg(F.min("w").alias("m"), F.count("*").alias("rows")).select(F.col("n").alias("n2"), F.least("n", "m").alias("m"), "rows")
    if total > hub_rows:
        least = settle(least, "least")
        met = join_counted(around, "n", least, "n2", "rows", hub_rows, total)
    else:
        met = around.join(least, F.col("n") == F.col("n2"))
    if both_ways:
        hung = met.filter(F.col("w") > F.col("n")).select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        hung = met.select(F.col("w").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n2").alias("u"), F.col("m").alias("v")))
    return hung.filter(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, *, hub_rows: int = HUB_ROWS) -> DataFrame:
    """``node``, ``label`` for every node of ``edges`` (long columns u, v): the label is the
    least node that it is connected with. Edges may repeat, loop and point either way; null
    ends are ignored; no edges give an empty table. Each round is written to the shared
    folder, so lineage stays short and a lost executor costs no earlier round."""
    now = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
        seen, before, total = state, now, 2 * state[0]
        middle = _stars(now, True, total, hub_rows)
        if total > hub_rows:
            middle = settle(middle, "edges")
        now = settle(_stars(middle, False, total, hub_rows), "edges")
        discard(before)
