"""Connected components of a stored table of links, by alternating large and small stars.

Each step replaces links by links to smaller neighbours; hubs are reduced by
``groupBy`` and joined back, never gathered in a task. Every step is stored in
the shared folder, so that lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from llm.common import F, stage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return near.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    pulled = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pulled.unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node with a link; ``links`` has columns u and v, the component is its smallest node.

    Links may repeat; a link of a node with itself is ignored. No links: no rows.
    """
    links = stage(links.where("u <> v").select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")))
    for _ in range(rounds):
        links = stage(_small_star(_large_star(links)).distinct())
        # stars only: every larger end has one link, and is nobody's smaller end
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionAll(links.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        if ends.where("ups > 1 OR (ups = 1 AND low = 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stage(links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots))


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The (node, component) table ``found`` after ``links`` (u, v) are added: only what they change between components is run."""
    for end in ("u", "v"):
        named = found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        links = links.join(named, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    merged = components(links)
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    old = found.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    # a component's name is one of its nodes, so that what is new has no row in found yet
    return stage(old.unionAll(merged.join(found, "node", "left_anti").select("node", "component")))
