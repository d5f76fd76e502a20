"""Queries on codecs, quality, vectors and the rest of the tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import codec, identity
from graphloom.functions import text as T
from graphloom.operators import quality, relational, search
from graphloom.operators import store as ops
from graphloom.plans.store import load, sql
from graphloom.registry import query


@query("SELECT q.vec_id AS query, e.vec_id AS key, CAST(round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS DOUBLE) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, e.vec_id) <= 10")
def vector_search_batch(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return quality.nearest(e, e.filter("key % 50 = 0"), 10).select("query", "key", "cosine")


@query("WITH t AS (SELECT node, score FROM (SELECT vec_id AS node, (vec_id * 37) % 101 / 10e0 AS score, embedding FROM embeddings) ORDER BY score DESC, node LIMIT 50), q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) SELECT node, round(0.7e0 * score / max(score) OVER () + 0.3e0 * list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM t JOIN embeddings ON vec_id = node, q")
def vector_rerank(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    asked = [float(x) for x in e.filter("vec_id = 3").first()["embedding"]]
    rows = e.select(F.col("vec_id").alias("node_hash"), (F.col("vec_id") * 37 % 101 / 10).alias("score"))
    return search.vector_rerank(rows, e.select(F.col("vec_id").alias("node_hash"), F.col("embedding").alias("vector")), asked, 0.7).select(F.col("node_hash").alias("node"), "score")


@query("SELECT vec_id, embedding FROM embeddings")
def vector_bytes(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", codec.floats_of(codec.bytes_of(F.col("embedding"))).alias("embedding"))


_LAST = "string_split(qualified_name, '/')[-1]"


@query(f"WITH {sql('symbols')} SELECT node_hash, doc || ' ' || CASE kind WHEN 'method' THEN 'method on a type' WHEN 'type' THEN 'type definition' ELSE kind END || ' ' || trim(regexp_replace(regexp_replace(regexp_replace({_LAST}, '^[^.]*[.]', ''), '[._]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')) || ' in package ' || string_split({_LAST}, '.')[1] || ' with signature ' || CASE WHEN contains(regexp_replace(signature, '^func ', ''), '(') THEN regexp_replace(regexp_replace(signature, '^func ', ''), '^[^(]*', '') ELSE signature END AS text FROM symbols")
def embed_texts(spark, d):
    c = F.col
    return load(spark, d, "symbols").select("node_hash", codec.embed_text(c("doc"), c("kind"), c("qualified_name"), c("signature")).alias("text"))


IMPORTS = ["", "./x", "../a/b", "fmt", "os/exec", "github.com/x/y", "react", "json"]


@query(f"SELECT p, CASE WHEN p = '' OR starts_with(p, '.') THEN '' WHEN string_split(p, '/')[1] IN ('fmt', 'os', 'json') THEN 'stdlib' ELSE 'external://' || string_split(p, '/')[1] END AS url FROM (SELECT unnest({IMPORTS!r}) AS p)")
def external_urls(spark, d):
    return spark.createDataFrame([(p,) for p in IMPORTS], "p string").select("p", codec.external_url(F.col("p"), "/", ("fmt", "os", "json")).alias("url"))


@query(f"WITH {sql('links')}, e AS (SELECT * REPLACE (CASE WHEN source_id % 5 = 0 THEN 'throws' ELSE edge_type END AS edge_type) FROM links) SELECT CASE WHEN target_hash IN (SELECT sha256('lost' || range) FROM range(0, 100000, 3)) THEN 'cross_repo' WHEN edge_type = 'throws' THEN 'stdlib' ELSE 'truly_dangling' END AS class, count(*) AS n FROM e WHERE target_hash NOT IN (SELECT node_hash FROM symbols WHERE id % 7 > 0) GROUP BY 1")
def dangling_classes(spark, d):
    edges = load(spark, d, "links").withColumn("edge_type", F.when(F.col("source_id") % 5 == 0, "throws").otherwise(F.col("edge_type")))
    others = spark.range(0, 100_000, 3).select(F.sha2(F.concat(F.lit("lost"), F.col("id").cast("string")), 256).alias("node_hash"))
    return ops.dangling_classes(edges, load(spark, d, "symbols").filter("id % 7 > 0"), others)


@query(f"WITH {sql('symbols')}, a AS (SELECT DISTINCT doc AS n FROM symbols WHERE id % 40 < 8), b AS (SELECT DISTINCT doc AS n FROM symbols WHERE id % 40 BETWEEN 4 AND 11) SELECT coalesce(a.n, b.n) AS name, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.n = b.n")
def pack_compare(spark, d):
    from graphloom.operators import context

    s = load(spark, d, "symbols").select(F.col("doc").alias("name"), "id")
    return context.delta(s.filter("id % 40 < 8"), s.filter("id % 40 between 4 and 11"), ["name"])


TASKS = ["Which tests are affected by this change?", "review the pull request", "find dead code and stale routes", "flow path between A and B", "hello world", "compare snapshot diff of changed files"]


@query(f"SELECT task, tools FROM (SELECT unnest({TASKS!r}) AS task, unnest(['test_scope', 'context_for_pr', 'stale_edges', 'flow_between', 'context_for_task', 'context_for_files,semantic_diff']) AS tools)")
def plan_turn(spark, d):
    return spark.createDataFrame([(t, ",".join(T.plan(t))) for t in TASKS], "task string, tools string")


# pairs by package, of groups of 2 to 500 symbols with three tokens or more, and at most five edges a symbol
SIM = """p AS (SELECT p_brand || '/' || p_size % 3 AS g, p_partkey AS k, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS t FROM part), q AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM p WHERE len(t) >= 3)"""


def _similar(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.concat_ws("/", "p_brand", (F.col("p_size") % 3).cast("string")).alias("g"), F.col("p_partkey").alias("k"), identity.token_set(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    return relational.similar_in_groups(part, "g", "k", "t", 0.4)


@query(f"WITH {SIM} SELECT a.g AS grp, a.k AS x, b.k AS y, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM q a JOIN q b ON a.g = b.g AND a.k < b.k WHERE a.n BETWEEN 2 AND 500 AND round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) > 0.4")
def similarity_groups(spark, d):
    return _similar(spark, d)


@query()
def similarity_capped(spark, d):
    return ops.similar_capped(_similar(spark, d))


@query()
def ranking_significance(spark, d):
    """Two rankings of labelled documents, by length and by id, compared by language and source."""
    from pyspark.sql.window import Window

    r = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars", F.concat_ws("/", "lang", "source").alias("query")).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("relevant")), "doc_id")
    total = r.groupBy("query").agg(F.sum("relevant").alias("total"))
    of = lambda order: relational.retrieval_metrics(r.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "doc_id"))).join(total, "query")).select("query", "ndcg")
    both = of(F.desc("n_chars")).withColumnRenamed("ndcg", "a").join(of(F.col("doc_id")).withColumnRenamed("ndcg", "b"), "query")
    return quality.compare(both, "a", "b")
