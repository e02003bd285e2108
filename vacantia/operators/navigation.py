"""Navigation over captured links: scored edges, bounded reach, best terminal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import score as K, urls as U
from ..session import stored
from .grouping import attach_group, first_by


def scored_edges(links: DataFrame, company: Column | None = None) -> DataFrame:
    """Link rows of captured pages as trusted, positively scored edges between page addresses."""
    scored = links.withColumns({
        "score": K.entry_score("label", "resolved"), "kind": F.coalesce(K.entry_type("label", "resolved"), F.lit("UNKNOWN")),
        "trusted": K.company_continuity("source_url", "resolved", company if company is not None else F.lit(None).cast("string")),
    })
    return scored.filter("score > 0 and trusted")


def page_edges(links: DataFrame) -> DataFrame:
    """Trusted edges between pages: source, target (addresses without query and fragment) and the best score of the links between them."""
    ends = scored_edges(links).select(U.page_of("source_url").alias("source"), U.page_of("resolved").alias("target"), F.col("score").cast("bigint").alias("score"))
    return ends.groupBy("source", "target").agg(F.max("score").alias("score"))


def bounded_reach(edges: DataFrame, seeds: DataFrame, source: str, target: str, max_depth: int = 3) -> DataFrame:
    """Breadth-first reach from seed nodes: node, its smallest depth, and the best score of an edge into it from the hop before.

    Edges are stored once and every frontier once, so a hop reads what the last one wrote.  A frontier meets the edges
    by ``attach_group``: a page that holds a large share of all edges keeps them where they are.  New nodes come from an
    aggregation, so a page that everything links to is one row per task, and nodes seen before are dropped, so cycles
    end.  Null nodes take no part."""
    edges = stored(edges.select(F.col(source).alias("_from"), F.col(target).alias("_to"), F.col("score").cast("bigint").alias("_score"))
                   .filter("_from is not null and _to is not null"))
    degrees = stored(edges.groupBy("_from").agg(F.count("*").alias("_degree")))
    first = seeds.select("node").filter("node is not null").distinct()
    frontier = stored(first.select("node", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("score")))
    seen = frontier
    for depth in range(1, max_depth + 1):
        open_ = degrees.join(frontier.select(F.col("node").alias("_from")), "_from").withColumn("_open", F.lit(True))
        step = attach_group(edges, open_, "_from").filter("_open")
        found = step.groupBy(F.col("_to").alias("node")).agg(F.max("_score").alias("score"))
        frontier = stored(found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "score"))
        seen = seen.unionByName(frontier)
    return seen


def best_terminal(terminals: DataFrame, root: str) -> DataFrame:
    """Terminal with the best score, nearest first, matching intent first."""
    return first_by(terminals, root, [(-F.col("score")).alias("s"), F.col("depth"), (~F.col("matches_intent")).alias("m"), F.col("node")])
