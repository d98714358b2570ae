"""Graph operators on edge tables (src, dst)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, stored


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component, the least id reachable.

    Least labels spread along edges and then jump along labels, so the rounds
    grow with the logarithm of the longest path; each round is stored.
    """
    links = stored(both_ways(edges), "links")
    labels = stored(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        near = links.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("near"))
        spread = labels.join(near, F.col("id") == F.col("src"), "left").select("id", F.least("component", "near").alias("component"))
        jump = spread.select(F.col("id").alias("at"), F.col("component").alias("far"))
        new = stored(spread.join(jump, F.col("component") == F.col("at"), "left").select("id", F.least("component", "far").alias("component")), "labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(links)
            return labels


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, itself not counted."""
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def communities(nodes: DataFrame, edges: DataFrame, least: int = 3, top: int = 5) -> DataFrame:
    """community, members, relations, key_entities: components of at least least nodes.

    key_entities are the top nodes by degree inside the component, ties by
    identifier; only they are gathered, whatever the component's size.
    """
    placed = components(nodes, edges)
    degree = placed.join(degrees(edges), "id", "left").select("id", "component", F.coalesce("degree", F.lit(0)).alias("degree"))
    best = degree.withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("degree"), "id"))).where(F.col("r") <= top)
    keys = best.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("key_entities"))
    inside = edges.join(placed.select(F.col("id").alias("src"), "component"), "src").groupBy("component").agg(F.count("*").alias("relations"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    out = sizes.join(keys, "component").join(inside, "component", "left")
    return out.select(F.col("component").alias("community"), "members", F.coalesce("relations", F.lit(0)).alias("relations"), "key_entities")


def existing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def paths(seeds: DataFrame, edges: DataFrame, hops: int = 2, most: int = 5) -> DataFrame:
    """Simple paths from each seed of up to hops steps, most least neighbours a step: seed, path, score.

    Each seed has its own visited nodes. score = sum of min(degree, 10) /
    (10 * length) / (1 + 0.1 * length). Paths end where no neighbour is left or
    at the last hop.
    """
    links = both_ways(edges)
    near = links.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("r") <= most).select("src", "dst")
    degree = degrees(edges)
    front = seeds.select(F.col("id").alias("seed"), F.array("id").alias("path"))
    done = None
    for _ in range(hops):
        step = front.withColumn("tip", F.element_at("path", -1)).join(near, F.col("tip") == F.col("src"), "left")
        step = step.withColumn("fresh", F.col("dst").isNotNull() & ~F.array_contains("path", F.coalesce("dst", F.lit(-1))))
        leaf = step.groupBy("seed", "path").agg(F.max("fresh").alias("any")).where("not any").select("seed", "path")
        done = leaf if done is None else done.union(leaf)
        front = step.where("fresh").select("seed", F.concat("path", F.array("dst")).alias("path"))
    every = done.union(front).distinct()
    scored = every.withColumn("node", F.explode("path")).join(degree, F.col("node") == F.col("id"), "left")
    n = F.size("path")
    out = scored.groupBy("seed", "path").agg(F.sum(F.least(F.coalesce("degree", F.lit(0)), F.lit(10))).alias("total"))
    return out.select("seed", "path", F.round(F.col("total") / (10 * n) / (1 + 0.1 * n), 6).alias("score"))


def extracted(df: DataFrame, names: Column, relate: Callable[[list[str], list[list[str]]], list[list[tuple[str, str, str]]]] | None = None) -> DataFrame:
    """doc_id, kind, source, target, id: the entities that texts name, and relations between them.

    relate, a model, gets texts with their entities, a batch at a time, and
    gives (source, target, type) of each; relations between names that are no
    entities of the text are dropped. Without it there are entities only. id is
    the hash of the source's name and type.
    """
    found = df.select("doc_id", "text", names.alias("names"))
    key = lambda name: F.sha2(F.concat(name, F.lit("_ENTITY")), 256)
    out = found.select("doc_id", F.explode("names").alias("source")).select("doc_id", F.lit("entity").alias("kind"), "source", F.lit("").alias("target"), key(F.col("source")).alias("id"))
    if relate is None:
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, own = frame["text"].fillna("").tolist(), [list(x) if x is not None else [] for x in frame["names"]]
            rows = [(i, kind, a, b) for i, known, made in zip(frame["doc_id"], own, relate(texts, own), strict=True) for a, b, kind in made if a in known and b in known]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "source", "target"])

    related = found.mapInPandas(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, kind string, source string, target string")
    return out.unionByName(related.withColumn("id", key(F.col("source"))))
