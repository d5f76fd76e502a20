"""The text index over six fields and its BM25 search, tiered name search, and fusion of channels."""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T
from graphloom.plans.lineage import cut, shared_dir

# The index's fields with their weights, and BM25's constants.
FIELDS = {"symbol_name": 10.0, "concepts": 5.0, "qualified_name": 3.0, "signature": 1.0, "file_path": 4.0, "doc": 3.0}
K1, B = 1.2, 0.75
#: Folders that postings are dealt to by term: a query reads those of its terms.
BUCKETS = 64


def documents(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """node_hash and the six texts of each symbol; one without a known file has an empty path."""
    j = nodes.join(files.select("file_hash", F.col("path").alias("file_path")), "file_hash", "left")
    q, path = F.col("qualified_name"), F.coalesce("file_path", F.lit(""))
    return j.select(
        "node_hash", T.search_tokens(T.symbol_name(q)).alias("symbol_name"), T.path_concepts(path).alias("concepts"), T.search_tokens(q).alias("qualified_name"),
        T.search_tokens(F.col("signature")).alias("signature"), path.alias("file_path"), F.coalesce("doc", F.lit("")).alias("doc"),
    )


class Index:
    """Postings (term, key, n words of the row, places in each field) in folders by term, and the table's size and mean."""

    def __init__(self, docs: DataFrame, key: str, fields: dict[str, float] = FIELDS):
        self.key, self.fields = key, fields
        words = [T.words_of(F.col(c)).alias(f"w{k}") for k, c in enumerate(fields)]
        rows = docs.select(key, *words).withColumn("n", sum((F.size(f"w{k}") for k in range(len(fields))), F.lit(0)))

        def spots(k: int) -> Column:
            return F.transform(f"w{k}", lambda w, i: F.struct(F.lit(k).alias("f"), i.alias("i"), w.alias("term")))

        each = F.array(*map(spots, range(len(fields))))
        hits = rows.select(key, "n", F.explode(F.flatten(each)).alias("h")).select(key, "n", "h.*")
        # a row's words stay together: its own terms are grouped, never a term's rows
        posts = hits.groupBy(key, "term").agg(F.first("n").alias("n"), F.collect_list(F.struct("f", "i")).alias("at"))
        self.path = f"{shared_dir(docs.sparkSession)}/graphloom-postings-{uuid.uuid4().hex}"
        posts.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64(key), F.lit(4))).write.partitionBy("bucket").parquet(self.path)
        self.size = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
        self.spark = docs.sparkSession

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _hits(self, clauses: list[tuple[str, str, str]]) -> DataFrame:
        """clause, key, n and tf (places weighted by field); a phrase's words stand one after the other in a field.

        The index is read once for all clauses, and only the folders of their words unless one asks for a prefix.
        """
        asked = self.spark.createDataFrame([(k, *c) for k, c in enumerate(clauses)], "clause int, kind string, field string, text string")
        words = F.when(F.col("kind") == "prefix", F.array(F.lower("text"))).otherwise(T.words_of(F.col("text")))
        each = asked.withColumn("words", words).select("clause", "kind", "field", F.size("words").alias("size"), F.posexplode("words").alias("j", "word"))
        rows = each.select("*", _bucket(F.col("word")).alias("b")).collect()  # the query's words
        posts = self.postings()
        if not any(r["kind"] == "prefix" for r in rows):
            posts = posts.filter(F.col("bucket").isin(sorted({r["b"] for r in rows})) & F.col("term").isin(sorted({r["word"] for r in rows})))
        at = list(self.fields)
        terms = self.spark.createDataFrame([(r["clause"], r["size"], r["j"], r["word"], at.index(r["field"]) if r["field"] else -1, r["kind"] == "prefix") for r in rows], "clause int, size int, j int, word string, only int, prefix boolean")
        on = F.when(F.col("prefix"), F.startswith("term", F.col("word"))).otherwise(F.col("term") == F.col("word"))
        found = posts.join(F.broadcast(terms), on).select("clause", "size", "j", "only", self.key, "n", F.explode("at").alias("p"))
        found = found.filter((F.col("only") < 0) | (F.col("p.f") == F.col("only"))).select("clause", "size", self.key, "n", F.col("p.f").alias("f"), (F.col("p.i") - F.col("j")).alias("i"), "j")
        whole = found.groupBy("clause", "size", self.key, "n", "f", "i").agg(F.countDistinct("j").alias("have"), F.count("*").alias("times")).filter("have = size")
        weight = F.element_at(F.array(*(F.lit(float(w)) for w in self.fields.values())), F.col("f") + 1)
        return whole.groupBy("clause", self.key, "n").agg(F.sum(weight * F.col("times") / F.col("size")).alias("tf"))

    def search(self, clauses: list[tuple[str, str, str]], k: int) -> DataFrame:
        """The k best rows (key, score, rank from 0) by BM25 summed over the clauses, ties by key. A clause that over half
        of the rows match weighs next to nothing."""
        docs, mean = float(self.size["docs"]), self.size["mean"] or 1.0
        found = cut(self._hits(clauses), "clauses")
        df = F.broadcast(found.groupBy("clause").agg(F.count("*").alias("df")))
        idf = F.greatest(F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / mean))
        best = found.join(df, "clause").groupBy(self.key).agg(F.round(F.sum(score), 6).alias("score")).orderBy(F.desc("score"), self.key).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), self.key)) - 1)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def ranked(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """A short list (key, rank from 0) in order."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select(key, "rank")


def tiered(nodes: DataFrame, primary: list[str], components: list[str]) -> DataFrame:
    """(node_hash, qualified_name, tier, word): names by the asked words, tier by tier.

    Exact names of primary words all count; prefixes up to 30 if there are under 15; the same for components if primary
    words gave nothing; endings of any word up to 20 if there are under 5; folders up to 40 if there are under 30.
    Within a tier by the word's place, then by name.
    """
    q = F.lower("qualified_name")
    name = F.substring_index(q, ".", -1)
    out, spark = None, nodes.sparkSession
    base = nodes.select("node_hash", "qualified_name")

    def add(words: list[str], tier: str, match, most: int | None) -> int:
        nonlocal out
        if not words:
            return 0 if out is None else out.count()
        place = F.lit(None).cast("int")
        for k, w in reversed(list(enumerate(words))):
            place = F.when(match(w.lower()), k).otherwise(place)
        hit = base.select("*", place.alias("word")).filter("word is not null")
        if out is not None:
            hit = hit.join(out.select("node_hash"), "node_hash", "left_anti")
        have = 0 if out is None else out.count()
        if most is not None:
            hit = hit.orderBy("word", "qualified_name", "node_hash").limit(max(0, most - have))
        found = cut(hit.withColumn("tier", F.lit(tier)), "tier")
        out = found if out is None else out.unionByName(found)
        return out.count()

    n = 0
    for words in (primary, components):
        if not n:
            n = add(words, "exact", lambda w: name == w, None)
            if n < 15:
                n = add(words, "prefix", lambda w: q.endswith(w) & name.startswith(w), 30)
    both = primary + components
    if n < 5:
        n = add([w for w in both if len(w) >= 4], "substring", lambda w: q.endswith(w), 20)
    if n < 30:
        n = add([w for w in both if len(w) >= 3], "path", lambda w: q.contains("/" + w) | q.contains(w + "/"), 40)
    if out is None:
        return spark.createDataFrame([], "node_hash string, qualified_name string, word int, tier string, rank int")
    order = F.when(F.col("tier") == "exact", 0).when(F.col("tier") == "prefix", 1).when(F.col("tier") == "substring", 2).otherwise(3)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(order, "word", "qualified_name", "node_hash")) - 1)


def focused(rows: DataFrame) -> DataFrame:
    """rank anew: the largest package's symbols first (two at least; of equal ones the one seen first), then the others.
    rows: node_hash, qualified_name, rank: a short list."""
    rows = rows.withColumn("pkg", T.seed_package(F.col("qualified_name")))
    own = Window.partitionBy("pkg")
    rows = rows.withColumns({"size": F.count("*").over(own), "first": F.min("rank").over(own)})
    best = F.first("pkg").over(Window.orderBy(F.desc("size"), "first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    top = F.max("size").over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumn("ahead", (F.col("pkg") == best) & (top > 1))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ahead"), "rank")) - 1).select("node_hash", "qualified_name", "rank")


def types_first(rows: DataFrame) -> DataFrame:
    """rank anew: types and interfaces ahead of others, otherwise in order. rows: node_hash, kind, rank."""
    ahead = F.col("kind").isin("type", "class", "interface", "struct")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(ahead), "rank")) - 1)


def by_path_words(rows: DataFrame, words: list[str]) -> DataFrame:
    """rank anew: names that hold more of the words first. rows: node_hash, qualified_name, rank."""
    low = F.lower("qualified_name")
    score = sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "rank")) - 1)


def peakedness(scores: DataFrame) -> DataFrame:
    """confidence: how far the first score stands above the tenth, 0 at 1.2 times, 1 at 3 times, 1 with under ten."""
    top = scores.orderBy(F.desc("score")).limit(10).agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("score").alias("tenth"))
    ratio = F.col("top") / F.nullif("tenth", F.lit(0.0))
    c = F.when(F.col("n") < 10, 1.0).when(F.col("top") <= 0, 0.0).when(ratio.isNull() | (ratio > 3), 1.0).when(ratio < 1.2, 0.0).otherwise((ratio - 1.2) / 1.8)
    return top.select(F.round(c, 6).alias("confidence"))


def graph_aliases(seeds: DataFrame, nodes: DataFrame, calls: DataFrame, most: int = 10) -> DataFrame:
    """(target, phrase) of the first seeds: words of the names of what calls them and what they call, and neighbours of two,
    but for generic words and those in the target's own name. Words in order of the neighbour's name."""
    s = seeds.filter(F.col("rank") < most).select("node_hash", F.substring_index("qualified_name", ".", -1).alias("target"))
    n = nodes.select(F.col("node_hash").alias("other"), "qualified_name")
    into = calls.select(F.col("target_hash").alias("node_hash"), F.col("source_hash").alias("other"), F.lit(0).alias("way"))
    out = calls.select(F.col("source_hash").alias("node_hash"), F.col("target_hash").alias("other"), F.lit(1).alias("way"))
    near = into.unionByName(out).join(F.broadcast(s), "node_hash").distinct().join(n, "other")
    bare = F.regexp_replace(F.substring_index("qualified_name", "/", -1), r"^[^.]*\.", "")
    words = F.filter(F.split(F.regexp_replace(bare, "(?<=[a-z])(?=[A-Z])", "."), "[._]"), lambda w: (F.octet_length(w) >= 3) & ~F.lower(w).isin(*T.ALIAS_GENERIC))
    rows = near.select("node_hash", "target", "way", "qualified_name", F.posexplode(F.transform(words, F.lower)).alias("k", "w")).filter(~F.contains(F.lower("target"), F.col("w")))
    first = rows.groupBy("node_hash", "target", "w").agg(F.min(F.struct("way", "qualified_name", "k")).alias("o"))
    order = Window.partitionBy("node_hash").orderBy("o")
    first = first.withColumn("next", F.lead("w").over(order))
    pair = F.when(F.col("next").isNotNull(), F.concat_ws(" ", "w", "next"))
    return first.select("target", F.explode(F.array(F.col("w"), pair)).alias("phrase")).filter("phrase is not null").distinct()


def auto_concepts(nodes: DataFrame) -> DataFrame:
    """(phrase, target): names of two words or more that are not generic, each phrase once with the least target."""
    name = F.substring_index("qualified_name", ".", -1)
    q = F.col("qualified_name")
    rows = nodes.filter(~(q.contains("mock") | q.contains("fake") | q.contains("/vendor/") | q.contains("/dist/") | q.contains("_test."))).select(name.alias("target"))
    parts = F.split(F.regexp_replace("target", "(?<=[a-z])(?=[A-Z])", "_"), "_")
    real = F.filter(parts, lambda w: (F.octet_length(w) >= 3) & ~F.lower(w).isin(*T.CONCEPT_GENERIC))
    rows = rows.filter(F.octet_length("target") >= 6).withColumns({"parts": parts, "real": real}).filter("size(parts) > 1 and size(real) > 1")
    return rows.groupBy(F.lower(F.array_join("real", " ")).alias("phrase")).agg(F.min("target").alias("target")).filter(F.length("phrase") >= 6)


def vector_rerank(rows: DataFrame, vectors: DataFrame, query: list[float], weight: float, first: int = 50) -> DataFrame:
    """Scores of the first rows mixed with their vectors' cosine to the query; rows without a vector keep theirs.
    rows: node_hash, score; vectors: node_hash, vector."""
    from graphloom.functions.identity import cosine

    top = rows.orderBy(F.desc("score"), "node_hash").limit(first)
    peak = F.max("score").over(Window.partitionBy(F.lit(0)))
    j = top.withColumn("norm", F.col("score") / peak).join(vectors, "node_hash", "left")
    c = cosine(F.col("vector"), F.array(*map(F.lit, query)))
    mixed = F.when(F.col("vector").isNull(), F.col("norm")).otherwise(weight * F.col("norm") + (1 - weight) * c)
    return j.select("node_hash", F.round(mixed, 6).alias("score")).orderBy(F.desc("score"), "node_hash")
