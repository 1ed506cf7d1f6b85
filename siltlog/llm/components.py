"""Connected components of an edge table, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(stage: Stage, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); nodes of one component, and only they, share a root.

    Each round every node moves to its neighbour with the least hash (or stays), then one step on, and the edges are
    renamed; the hash order shortens paths by a constant share whatever the ids are. Repeated edges and loops do no harm; an
    empty table gives no rows.
    """
    edges = stage.put(edges.select("u", "v").where("u <> v").distinct(), "edges")
    found: DataFrame | None = None
    h = F.xxhash64
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(h("v").alias("h"), F.col("v").alias("v"))).alias("m"))
        up = stage.put(least.select(F.col("u").alias("node"), F.when(F.col("m") < F.struct(h("u").alias("h"), F.col("u").alias("v")), F.col("m.v")).otherwise(F.col("u")).alias("up")), "up")
        jump = stage.put(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("root")), "up").select("node", "root"), "jump")
        if found is None:
            found = jump
        else:
            step = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = stage.put(found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "found")
        a = jump.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = jump.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        new = stage.put(edges.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        stage.drop(edges, up)
        edges = new
    return found if found is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
