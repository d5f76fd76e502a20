"""Communities of a weighted graph: algorithms by name, also from a former result, and what is told of each community."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import iterative
from graphloom.plans.lineage import cut

#: Algorithms by name: Louvain at two resolutions, and label propagation, which alone scales past one task.
ALGORITHMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "louvain": lambda edges: iterative.louvain(edges, 1.0),
    "louvain-fine": lambda edges: iterative.louvain(edges, 0.3),
    "label-propagation": lambda edges: iterative.label_propagation(edges, 50, stable=True).select("node", F.col("label").alias("community")),
}


def detect(edges: DataFrame, name: str = "louvain") -> DataFrame:
    """(node, community) of edges (u, v, w)."""
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name}; one of {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[name](edges)


def propagate_from(edges: DataFrame, former: DataFrame, changed: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label) by label propagation from a former result: only changed nodes (node) and new ones take new labels, by
    the weight of their neighbours', ties to the least; it ends once none changes."""
    both = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w")), "both")
    nodes = both.select(F.col("u").alias("node")).distinct()
    known = nodes.join(former.select("node", "label"), "node", "left")
    free = known.filter("label is null").select("node").unionByName(changed.select("node")).distinct()
    free = cut(free.join(nodes, "node", "left_semi"), "free")
    labels = cut(known.select("node", F.coalesce("label", "node").alias("label")), "labels")
    mine = cut(both.join(free.withColumnRenamed("node", "u"), "u", "left_semi"), "mine")
    for _ in range(rounds):
        votes = mine.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("u").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("to"))
        moved = cut(labels.join(best, "node", "left").select("node", F.coalesce("to", "label").alias("label"), (F.coalesce("to", "label") != F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            break
    return labels


def describe(nodes: DataFrame, members: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """Each community by size: id, size, cohesion (share of its nodes' edge ends that stay inside, two places), its five
    symbols of most inner edges, the package most of them are of, all packages, and a root over those. From the `most`-th on
    they are one row `other` with their size alone. nodes: node_hash, qualified_name, package; members: node_hash,
    community; edges: u, v, each pair once, both known."""
    m = members.select("node_hash", "community")
    rows = nodes.join(m, "node_hash")
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    ends = both.join(m.toDF("u", "cu"), "u").join(m.toDF("v", "cv"), "v")
    degree = ends.groupBy(F.col("u").alias("node_hash")).agg(F.count("*").alias("all_"), F.count_if(F.col("cu") == F.col("cv")).alias("inner"))
    rows = cut(rows.join(degree, "node_hash", "left").fillna(0, ["all_", "inner"]), "members")
    g = rows.groupBy("community").agg(F.count("*").alias("size"), F.round(F.coalesce(F.try_divide(F.sum("inner"), F.sum("all_")), F.lit(0.0)), 2).alias("cohesion"))
    # the five first of each are found by partial maxima, never by ordering a whole community
    five = rows.groupBy("community", F.pmod(F.xxhash64("node_hash"), F.lit(256)).alias("b")).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("inner")).alias("d"), "qualified_name"))), 1, 5).alias("t"))
    five = five.groupBy("community").agg(F.slice(F.sort_array(F.flatten(F.collect_list("t"))), 1, 5).alias("t")).select("community", F.col("t.qualified_name").alias("top_symbols"))
    packs = rows.groupBy("community", "package").agg(F.count("*").alias("n"))
    packs = packs.groupBy("community").agg(F.min_by("package", F.struct(-F.col("n"), F.col("package"))).alias("dominant_package"), F.sort_array(F.collect_set("package")).alias("packages"))
    root = F.sha2(F.array_join(F.transform("packages", lambda p: F.sha2(p, 256)), ""), 256)
    out = g.join(five, "community").join(packs, "community").withColumn("root", root)
    listed = out.withColumn("id", F.row_number().over(Window.orderBy(F.desc("size"), "community")) - 1)  # a row a community
    shown = most - 1 if listed.count() > most else most
    first = listed.filter(F.col("id") < shown)
    rest = listed.filter(F.col("id") >= shown).agg(F.sum("size").alias("size")).filter("size is not null")
    none = F.lit(None)
    other = rest.select(none.cast(listed.schema["community"].dataType).alias("community"), "size", F.lit(0.0).alias("cohesion"), F.array().cast("array<string>").alias("top_symbols"), F.lit("other").alias("dominant_package"), F.array().cast("array<string>").alias("packages"), none.cast("string").alias("root"), F.lit(shown).alias("id"))
    return first.unionByName(other).select("id", "community", "size", "cohesion", "top_symbols", "dominant_package", "packages", "root")


def neighbours(members: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(community, own): that of a symbol, and those that edges from its members reach."""
    m = members.select("node_hash", "community")
    mine = m.filter(F.col("node_hash") == node).select("community").distinct()
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    inside = m.join(F.broadcast(mine), "community", "left_semi").select(F.col("node_hash").alias("u"))
    out = both.join(inside, "u", "left_semi").join(m.toDF("v", "community"), "v").select("community").distinct().join(mine, "community", "left_anti")
    return mine.withColumn("own", F.lit(True)).unionByName(out.withColumn("own", F.lit(False)))


def as_notes(members: DataFrame, now: int) -> DataFrame:
    """Assignments as notes, to be put into a store."""
    return members.select("node_hash", F.col("community").cast("string").alias("value")).select(F.col("node_hash").alias("object_hash"), F.lit("community_id").alias("note_key"), "value", F.lit(now).cast("long").alias("updated_at"))


def changed_notes(members: DataFrame, notes: DataFrame, now: int) -> DataFrame:
    """Only the assignments that the notes don't hold as they are."""
    old = notes.filter("note_key = 'community_id'").select("object_hash", F.col("value").alias("was"))
    return as_notes(members, now).join(old, "object_hash", "left").filter(~F.equal_null("was", "value")).drop("was")


def from_notes(notes: DataFrame) -> DataFrame:
    """(node_hash, community); values that are no whole numbers are passed over."""
    return notes.filter("note_key = 'community_id'").select(F.col("object_hash").alias("node_hash"), F.expr("try_cast(value as long)").alias("community")).filter("community is not null")
