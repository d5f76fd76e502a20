"""Source trees into nodes and edges: files are read by Spark, each file's text is extracted where it was read."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import identity

# Folders that are not walked, and generated files.
SKIPPED = "vendor node_modules testdata __pycache__ target build dist out corpus staging third_party _output hack".split()
GENERATED = r"(^|/)zz_generated[^/]*$|\.pb\.go$|\.pb\.gw\.go$|_generated\.go$"
SYMBOL = "path string, content_hash string, name string, kind string, line int, signature string, doc string"
CALL = "path string, source string, target string, edge_type string, line int"

#: Extractors by extension: text -> (symbols as (name, kind, line, signature, doc), links as (source, target, type, line)).
EXTRACTORS: dict[str, Callable[[str], tuple[list[tuple], list[tuple]]]] = {}


def extractor(*extensions: str):
    def register(f):
        EXTRACTORS.update(dict.fromkeys(extensions, f))
        return f

    return register


@extractor("py")
def python(text: str) -> tuple[list[tuple], list[tuple]]:
    """Classes, functions and methods of a module, what they call, extend and import, by names as written."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], []
    symbols: list[tuple] = []
    links: list[tuple] = []

    def name_of(x) -> str:
        return x.id if isinstance(x, ast.Name) else f"{name_of(x.value)}.{x.attr}".lstrip(".") if isinstance(x, ast.Attribute) else ""

    def go(body, owner: str) -> None:
        for x in body:
            if isinstance(x, ast.ClassDef):
                name = f"{owner}.{x.name}".lstrip(".")
                symbols.append((name, "type", x.lineno, f"class {x.name}", (ast.get_docstring(x) or "").split("\n")[0]))
                links.extend((name, b, "extends", x.lineno) for b in map(name_of, x.bases) if b)
                go(x.body, name)
            elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                name = f"{owner}.{x.name}".lstrip(".")
                args = ", ".join(a.arg for a in x.args.args)
                symbols.append((name, "method" if owner else "function", x.lineno, f"def {x.name}({args})", (ast.get_docstring(x) or "").split("\n")[0]))
                called = {(name_of(c.func), c.lineno) for c in ast.walk(x) if isinstance(c, ast.Call)}
                links.extend((name, to, "calls", line) for to, line in sorted(called) if to)
            elif isinstance(x, ast.Import | ast.ImportFrom):
                base = f"{x.module}." if isinstance(x, ast.ImportFrom) and x.module else ""
                links.extend(("", base + a.name, "imports", x.lineno) for a in x.names)

    go(tree.body, "")
    return symbols, links


_GO_FUNC = re.compile(r"^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*(\([^{]*?)\s*\{", re.M)
_GO_TYPE = re.compile(r"^type\s+(\w+)\s+(struct|interface)\b", re.M)


@extractor("go")
def go(text: str) -> tuple[list[tuple], list[tuple]]:
    """Top-level types, functions and methods, and imports, by their form at the beginning of a line."""
    line = lambda at: text.count("\n", 0, at) + 1
    symbols = [(m[1], "interface" if m[2] == "interface" else "type", line(m.start()), f"type {m[1]} {m[2]}", "") for m in _GO_TYPE.finditer(text)]
    symbols += [(f"{m[1]}.{m[2]}" if m[1] else m[2], "method" if m[1] else "function", line(m.start()), f"func {m[2]}{m[3].strip()}", "") for m in _GO_FUNC.finditer(text)]
    block = re.search(r"^import\s*(?:\((.*?)\)|(\"[^\"]*\"))", text, re.M | re.S)
    links = [("", x, "imports", line(block.start())) for x in re.findall(r'"([^"]+)"', block[1] or block[2])] if block else []
    return symbols, links


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path (under root), content and content_hash of the files that an extractor knows; skipped folders, hidden ones but
    .github, and generated files are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(sorted(EXTRACTORS)) + "}").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    path = F.regexp_replace("path", "^.*?" + re.escape(whole) + "/", "")
    rows = rows.select(path.alias("path"), "content")
    folders = r"(^|/)(" + "|".join(map(re.escape, SKIPPED)) + ")/"
    hidden = r"(^|/)\.(?!github/)[^/]+/"
    return rows.filter(~F.col("path").rlike(folders) & ~F.col("path").rlike(hidden) & ~F.col("path").rlike(GENERATED)).withColumn("content_hash", F.sha2("content", 256))


def _extract(files: DataFrame, what: int, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = EXTRACTORS[path.rsplit(".", 1)[-1]](content.decode("utf-8", "replace"))[what]
                rows += [(path, digest, *x) if what == 0 else (path, *x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if n == "line" else pa.string()) for k, n in enumerate(names)], names)

    return files.select("path", "content", "content_hash").mapInArrow(run, schema)


def index(files: DataFrame, repo_url: str, former: DataFrame | None = None) -> dict[str, DataFrame]:
    """files, nodes and edges of a tree (see walk). Files whose path and hash stand in `former` (path, content_hash) are
    passed over. A file is a node too, from which its imports lead. An edge's target is a symbol of that name in the same
    file, or else external by its first part."""
    fresh = files if former is None else files.join(former.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
    repo = F.lit(repo_url)
    rows = _extract(fresh, 0, SYMBOL)
    node = identity.node_hash(repo, F.col("path"), F.col("name"), F.col("kind"))
    file_hash = F.sha2(F.concat(repo, F.lit(":"), "path", F.lit(":"), "content_hash"), 256)
    q = F.concat(repo, F.lit("://"), "path", F.lit("."), "name")
    nodes = rows.select(node.alias("node_hash"), file_hash.alias("file_hash"), q.alias("qualified_name"), "kind", "line", "signature", "doc", "path", "name").dropDuplicates(["node_hash"])
    own = F.concat(repo, F.lit("://"), "path")
    as_file = identity.node_hash(repo, F.col("path"), F.lit(""), F.lit("file"))
    nodes = nodes.unionByName(fresh.select(as_file.alias("node_hash"), file_hash.alias("file_hash"), own.alias("qualified_name"), F.lit("file").alias("kind"), F.lit(1).alias("line"), F.lit("").alias("signature"), F.lit("").alias("doc"), "path", F.lit("").alias("name")))
    listed = fresh.select(file_hash.alias("file_hash"), F.sha2(repo, 256).alias("repo_hash"), "path", "content_hash")
    by_name = nodes.filter("name <> ''").groupBy("path", "name").agg(F.min("node_hash").alias("h"))
    last = nodes.filter("name <> ''").groupBy("path", F.substring_index("name", ".", -1).alias("target")).agg(F.min("node_hash").alias("t"))
    links = _extract(fresh, 1, CALL).distinct().withColumn("full", F.col("target")).withColumn("target", F.substring_index("target", ".", -1))
    j = links.join(by_name.select("path", F.col("name").alias("source"), F.col("h").alias("s")), ["path", "source"], "left").join(last, ["path", "target"], "left")
    source = F.coalesce("s", identity.node_hash(repo, F.col("path"), F.lit(""), F.lit("file")))
    outside = identity.node_hash(F.concat(F.lit("external://"), F.substring_index("full", ".", 1)), F.lit(""), F.col("full"), F.lit("external"))
    e = j.select(source.alias("source_hash"), F.coalesce("t", outside).alias("target_hash"), "edge_type", F.lit("ast_inferred").alias("provenance"), F.lit(0.7).alias("confidence"), F.col("line").alias("callsite_line"), F.col("path").alias("callsite_file"))
    e = e.withColumn("edge_hash", identity.edge_hash(F.col("source_hash"), F.col("target_hash"), F.col("edge_type"), F.col("provenance"))).dropDuplicates(["edge_hash"])
    return {"files": listed, "nodes": nodes, "edges": e}


def modules(texts: DataFrame) -> DataFrame:
    """(module, repo_url) of go.mod files (repo_url, content): the module that each names; the least repository of several."""
    name = F.regexp_extract(F.col("content").cast("string"), r"(?m)^module\s+(\S+)", 1)
    return texts.select("repo_url", name.alias("module")).filter("module <> ''").groupBy("module").agg(F.min("repo_url").alias("repo_url"))


def watch(spark: SparkSession, root: str, after: Callable[[list[str]], None], checkpoint: str, seconds: int = 2, once: bool = False):
    """Tell `after` the paths that came or changed, a micro-batch every some seconds: what came meanwhile comes together."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(sorted(EXTRACTORS)) + "}").load(root)

    def tell(batch: DataFrame, number: int) -> None:
        after(sorted(r["path"] for r in batch.select("path").distinct().collect()))  # names of the files of one micro-batch

    writer = rows.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


class Roster:
    """Which stores there are: name, root and repository, as rows of a table of its own."""

    SCHEMA = "name string, root string, repo_url string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def list(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        known = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(self.SCHEMA).json(self.path).orderBy("name") if known else self.spark.createDataFrame([], self.SCHEMA)

    def _put(self, rows: list) -> None:
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("overwrite").json(self.path)

    def add(self, name: str, root: str, repo_url: str) -> None:
        self._put([tuple(r) for r in self.list().collect() if r["name"] != name] + [(name, root, repo_url)])

    def remove(self, name: str) -> bool:
        rows = self.list().collect()
        self._put([tuple(r) for r in rows if r["name"] != name])
        return any(r["name"] == name for r in rows)

    def root_of(self, path: str) -> str | None:
        """The store whose repository holds a path: the longest one that does."""
        fit = [r for r in self.list().collect() if path == r["repo_url"] or path.startswith(r["repo_url"].rstrip("/") + "/")]
        return max(fit, key=lambda r: len(r["repo_url"]))["root"] if fit else None
