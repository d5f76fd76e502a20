"""Merkle roots by package and edge type, proofs, and diffs of snapshots.

Leaves of a group stand in order of their bytes. Neighbours are paired, level by level, an odd last one with itself; one
leaf is its own root, but the root over packages pairs even a single one with itself.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.plans.lineage import cut

#: Nodes that one task folds: a power of two, so that a full block is a whole subtree.
BLOCK = 1 << 14
ROOT = "_root"


def parent(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"merkle\0" + left + right).digest()


def _up(level: list[bytes]) -> list[bytes]:
    return [parent(level[k], level[min(k + 1, len(level) - 1)]) for k in range(0, len(level), 2)]


def fold(leaves: list[bytes], pair_single: bool = False) -> bytes:
    """Root of a few leaves; no leaf gives zeros."""
    level = sorted(leaves)
    if not level:
        return bytes(32)
    if len(level) == 1:
        return parent(level[0], level[0]) if pair_single else level[0]
    while len(level) > 1:
        level = _up(level)
    return level[0]


def steps_of(level: list[bytes], at: int, height: int | None = None) -> list[tuple[str, bytes]]:
    """Siblings from place `at` of nodes in order up to their root, or up to a height."""
    out: list[tuple[str, bytes]] = []
    while len(level) > 1 or (height is not None and len(out) < height):
        other = min(at ^ 1, len(level) - 1)
        out.append(("left" if other < at else "right", level[other]))
        level, at = _up(level), at // 2
    return out


def proof(leaves: list[bytes], leaf: bytes, pair_single: bool = False) -> list[tuple[str, bytes]]:
    """Siblings from the leaf up, each with the side it stands on; ValueError if the leaf is not among them."""
    level = sorted(leaves)
    at = level.index(leaf)
    if len(level) == 1:
        return [("right", leaf)] if pair_single else []
    return steps_of(level, at)


def climb(leaf: bytes, steps: list[tuple[str, bytes]]) -> bytes:
    return reduce(lambda x, s: parent(s[1], x) if s[0] == "left" else parent(x, s[1]), steps, leaf)


def verify(leaf: bytes, steps: list[tuple[str, bytes]], root: bytes) -> bool:
    return climb(leaf, steps) == root


# ---------------------------------------------------------------- trees in parts


def placed(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """keys, leaf and pos (from 0 within its group, in order). A large group lies in many partitions; a partition's first
    group is told how many of its leaves lie before, so that no task orders a whole group."""
    ranged = cut(leaves.select(*keys, "leaf").repartitionByRange(*keys, "leaf").withColumn("part", F.spark_partition_id()), "leaves")
    sizes = ranged.groupBy("part", *keys).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    goes_on = sizes.select("part", *keys, before.alias("before")).filter("before > 0")  # at most one a partition
    here = F.row_number().over(Window.partitionBy("part", *keys).orderBy("leaf")) - 1
    rows = ranged.withColumn("here", here).join(F.broadcast(goes_on), ["part", *keys], "left")
    return rows.select(*keys, "leaf", (F.col("here") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"))


def _blocks(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """One level of blocks: keys, pos (of the block), root (of the block alone), full (of it within a larger tree), n."""
    height = block.bit_length() - 1
    schema = rows.select(*keys).schema

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        level = [bytes.fromhex(x) for x in pdf["full"]]
        up = 0
        while len(level) > 1:
            level, up = _up(level), up + 1
        alone = pdf["root"].iloc[0] if len(pdf) == 1 else level[0].hex()
        whole = level[0]
        for _ in range(height - up):
            whole = parent(whole, whole)
        return pd.DataFrame({**dict(zip(keys, ([k] for k in key), strict=False)), "pos": [key[-1]], "root": [alone], "full": [whole.hex()], "n": [int(pdf["n"].sum())]})

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in schema)
    grouped = rows.withColumn("block", F.floor(F.col("pos") / block).cast("long")).groupBy(*keys, "block")
    return grouped.applyInPandas(run, f"{kinds}pos long, root string, full string, n long")


def fold_groups(leaves: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """keys, root and leaves (their number) of each group of rows (keys, leaf in hex)."""
    rows = placed(leaves, keys).select(*keys, "pos", F.col("leaf").alias("root"), F.col("leaf").alias("full"), F.lit(1).cast("long").alias("n"))
    while True:
        rows = cut(_blocks(rows, keys, block), "blocks")
        if rows.filter("pos > 0").isEmpty():
            return rows.select(*keys, "root", F.col("n").alias("leaves"))


def path_in(leaves: DataFrame, leaf: str, block: int = BLOCK) -> list[tuple[str, bytes]]:
    """The proof of one leaf among rows (leaf): a block of each level comes to the driver, never all leaves."""
    rows = placed(leaves.withColumn("g", F.lit(0)), ["g"]).select("g", "pos", F.col("leaf").alias("root"), F.col("leaf").alias("full"), F.lit(1).cast("long").alias("n"))
    rows = cut(rows, "placed")
    found = rows.filter(F.col("root") == leaf).agg(F.min("pos")).first()[0]
    if found is None:
        raise ValueError("no such leaf")
    out: list[tuple[str, bytes]] = []
    height = block.bit_length() - 1
    while True:
        last = rows.agg(F.max("pos")).first()[0]
        own = rows.filter((F.col("pos") >= found // block * block) & (F.col("pos") < (found // block + 1) * block)).orderBy("pos")
        level = [bytes.fromhex(r["full"]) for r in own.select("full").collect()]  # `block` at most
        out += steps_of(level, found % block, height if last >= block else None)
        if last < block:
            return out
        rows, found = cut(_blocks(rows, ["g"], block), "blocks"), found // block


def _leaves(edges: DataFrame) -> DataFrame:
    package = F.when(F.col("package_path") == "", ROOT).otherwise(F.col("package_path"))
    return edges.select(package.alias("package_path"), "edge_type", F.col("edge_hash").alias("leaf")).distinct()


def roots(edges: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(package_path, edge_type, root, leaves) and (package_path, root, leaves) of edges with package_path, edge_type,
    edge_hash; equal edges count once, an empty package is `_root`."""
    types = fold_groups(_leaves(edges), ["package_path", "edge_type"], block)
    packages = fold_groups(types.select("package_path", F.col("root").alias("leaf")), ["package_path"], block)
    return types, packages


def _top(rows: DataFrame) -> DataFrame:
    """root and packages of rows (root): over all, a single one paired with itself; no row gives no root."""
    one = F.sha2(F.concat(F.lit("merkle\0").cast("binary"), F.unhex("root"), F.unhex("root")), 256)
    folded = fold_groups(rows.select(F.lit(0).alias("g"), F.col("root").alias("leaf")), ["g"])
    return folded.select(F.when(F.col("leaves") == 1, one).otherwise(F.col("root")).alias("root"), F.col("leaves").alias("packages"))


def repo_root(packages: DataFrame) -> DataFrame:
    return _top(packages)


def subgraph_root(packages: DataFrame, names: list[str]) -> DataFrame:
    """The root over some packages: it changes when any of them does. Unknown names are passed over."""
    return _top(packages.filter(F.col("package_path").isin(*names)))


def edge_type_root(types: DataFrame, edge_type: str) -> DataFrame:
    """The root of one kind of edges over all packages."""
    return _top(types.filter(F.col("edge_type") == edge_type))


def prove(edges: DataFrame, edge_hash: str, package: str, edge_type: str, block: int = BLOCK) -> dict:
    """Proof in three levels: among the edges of the type, among the package's types, among the packages."""
    types, packages = roots(edges, block)
    own = _leaves(edges).filter((F.col("package_path") == package) & (F.col("edge_type") == edge_type))
    low = path_in(own.select("leaf"), edge_hash, block)
    type_root = climb(bytes.fromhex(edge_hash), low).hex()
    middle = path_in(types.filter(F.col("package_path") == package).select(F.col("root").alias("leaf")), type_root, block)
    package_root = climb(bytes.fromhex(type_root), middle).hex()
    high = path_in(packages.select(F.col("root").alias("leaf")), package_root, block) or [("right", bytes.fromhex(package_root))]
    return {"edge": edge_hash, "steps": (low, middle, high), "type_root": type_root, "package_root": package_root, "repo_root": climb(bytes.fromhex(package_root), high).hex()}


def verify_proof(found: dict) -> bool:
    low, middle, high = found["steps"]
    return (
        climb(bytes.fromhex(found["edge"]), low).hex() == found["type_root"]
        and climb(bytes.fromhex(found["type_root"]), middle).hex() == found["package_root"]
        and climb(bytes.fromhex(found["package_root"]), high).hex() == found["repo_root"]
    )


def prove_absence(edges: DataFrame, edge_hash: str, package: str, edge_type: str, block: int = BLOCK) -> dict:
    """Proofs of the neighbours between which the missing edge would stand; none where the group does not exist."""
    own = _leaves(edges).filter((F.col("package_path") == package) & (F.col("edge_type") == edge_type))
    row = own.agg(F.count_if(F.col("leaf") == edge_hash).alias("n"), F.max(F.when(F.col("leaf") < edge_hash, F.col("leaf"))).alias("left"), F.min(F.when(F.col("leaf") > edge_hash, F.col("leaf"))).alias("right")).first()
    if row["n"]:
        raise ValueError("the edge exists")
    sides = {side: prove(edges, row[side], package, edge_type, block) if row[side] else None for side in ("left", "right")}
    known = sides["left"] or sides["right"]
    root = known["repo_root"] if known else repo_root(roots(edges, block)[1]).first()["root"]
    return {"missing": edge_hash, **sides, "repo_root": root}


def verify_absence(found: dict) -> bool:
    """Both neighbours hold under the same root and stand on either side. That they are neighbours is not checked."""
    left, right, missing = found["left"], found["right"], found["missing"]
    whole = all(verify_proof(p) and p["repo_root"] == found["repo_root"] for p in (left, right) if p)
    return whole and (not left or left["edge"] < missing) and (not right or right["edge"] > missing)


# ---------------------------------------------------------------- snapshots


def snapshot_row(edges: DataFrame, parents: DataFrame, repo: str, now: int) -> DataFrame:
    """The next snapshot of a repository: hash of its root, the latest one as parent, one generation more, counts.

    edges: as for roots, with source_hash and target_hash; parents: the repository's snapshots (snapshot_hash, generation, made_at).
    """
    top = repo_root(cut(roots(edges)[1], "packages"))
    last = parents.orderBy(F.desc("made_at"), F.desc("snapshot_hash")).limit(1).select(F.col("snapshot_hash").alias("parent_hash"), F.col("generation").alias("g"))
    count = edges.agg(F.countDistinct("edge_hash").alias("edge_count"))
    ends = edges.select(F.explode(F.array("source_hash", "target_hash")).alias("h")).agg(F.countDistinct("h").alias("node_count"))
    digest = F.sha2(F.concat(F.lit("snapshot\0").cast("binary"), F.unhex("root")), 256)
    out = count.join(ends).join(top, how="left").join(last, how="left")
    return out.select(digest.alias("snapshot_hash"), "parent_hash", F.lit(repo).alias("repo_hash"), F.lit(now).alias("made_at"), "node_count", "edge_count", (F.coalesce("g", F.lit(-1)) + 1).cast("int").alias("generation"))


def roots_as_notes(packages: DataFrame, now: int) -> DataFrame:
    """Package roots as notes on the packages' hashes, to be put into the store."""
    return packages.select(F.sha2("package_path", 256).alias("object_hash"), F.lit("package_root").alias("note_key"), F.col("root").alias("value"), F.lit(now).cast("long").alias("updated_at"))


def root_of_symbols(symbols: DataFrame, notes: DataFrame) -> DataFrame:
    """qualified_name and the noted root of the folder that it names: the text after `://` up to the last slash, which is
    the package's key only where packages are folders; null where nothing is noted."""
    folder = F.regexp_extract("qualified_name", r"://(.*)/[^/]*$", 1)
    kept = notes.filter("note_key = 'package_root'").select("object_hash", F.col("value").alias("root"))
    return symbols.select("qualified_name", F.sha2(folder, 256).alias("object_hash")).join(kept, "object_hash", "left").select("qualified_name", "root")


def leaf_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = old.select("edge_hash").distinct(), new.select("edge_hash").distinct()
    return b.join(a, "edge_hash", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "edge_hash", "left_anti").withColumn("change", F.lit("removed")))


def package_prints(edges: DataFrame) -> DataFrame:
    """Of each (package, type) its leaves' number and three sums over them, which any change of the set changes but for a
    chance of some 2^-100: they add up in parts, where a root needs all leaves in order."""
    rows = edges.select("package_path", "edge_type", "edge_hash").distinct()
    whole = lambda seed: F.sum(F.xxhash64("edge_hash", F.lit(seed)).cast("decimal(20,0)"))
    return rows.groupBy("package_path", "edge_type").agg(F.struct(F.count("*"), whole(1), whole(2)).alias("print"))


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edge types of packages that differ, with `change` added, removed or changed."""
    a, b = package_prints(old), package_prints(new)
    joined = a.withColumnRenamed("print", "x").join(b.withColumnRenamed("print", "y"), ["package_path", "edge_type"], "full")
    changed = joined.filter(~F.equal_null("x", "y"))
    return changed.select("package_path", "edge_type", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))


def package_diff(old: DataFrame, new: DataFrame, only: list[str] | None = None, most: int = 0) -> DataFrame:
    """(package_path, change, edge_types, truncated): added, removed and changed packages; of those not removed the types
    that differ. `only` names packages to look at. `most` keeps the first added and changed ones by name, then the removed
    ones, and says so: a report's length, as asked for."""
    if only is not None:
        old, new = (x.filter(F.col("package_path").isin(*only)) for x in (old, new))
    a, b = (x.groupBy("package_path").agg(F.lit(True).alias(n)) for x, n in ((old, "a"), (new, "b")))
    types = tree_diff(old, new).groupBy("package_path").agg(F.sort_array(F.collect_set(F.when(F.col("change") != "removed", F.col("edge_type")))).alias("edge_types"))
    j = types.join(a, "package_path", "left").join(b, "package_path", "left")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    out = j.select("package_path", change.alias("change"), F.when(F.col("b").isNull(), F.array().cast("array<string>")).otherwise(F.col("edge_types")).alias("edge_types"))
    if most <= 0:
        return out.withColumn("truncated", F.lit(False))
    kept = cut(out.orderBy(F.col("change") == "removed", "package_path").limit(most + 1), "changes")
    return kept.orderBy(F.col("change") == "removed", "package_path").limit(most).withColumn("truncated", F.lit(kept.count() > most))


# Kinds of edges whose change is one of behaviour, of what was seen at run time, and of structure.
BEHAVIOUR = ("calls", "throws", "publishes", "subscribes", "connects_to")
RUNTIME = ("runtime_calls", "runtime_rpc", "runtime_produces", "runtime_consumes")
STRUCTURE = ("imports", "implements", "extends", "overrides", "depends_on", "decorates")


def classify(packages: DataFrame) -> DataFrame:
    """One row of a package_diff: how many changed types are of behaviour, of run time, of structure (and added and removed
    packages), of neither, and the gravest of these classes."""
    rows = packages.select("change", F.explode_outer("edge_types").alias("t"))
    of = lambda kinds: F.count_if(F.col("t").isin(*kinds))
    moved = packages.agg(F.count_if(F.col("change") != "changed").alias("moved"))
    g = rows.agg(of(BEHAVIOUR).alias("behavioral"), of(RUNTIME).alias("runtime_drift"), of(STRUCTURE).alias("s"), F.count_if(~F.col("t").isin(*BEHAVIOUR, *RUNTIME, *STRUCTURE)).alias("metadata_only")).join(moved)
    g = g.select("behavioral", "runtime_drift", (F.col("s") + F.col("moved")).alias("structural"), "metadata_only")
    order = ("behavioral", "runtime_drift", "structural", "metadata_only")
    name = F.lit("no_change")
    for k in reversed(order):
        name = F.when(F.col(k) > 0, k).otherwise(name)
    return g.withColumn("class", name)
