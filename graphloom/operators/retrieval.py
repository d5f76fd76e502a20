"""Text and vector retrieval, rank fusion, scoring and packing into a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import identity
from graphloom.plans.lineage import cut

K1, B = 1.2, 0.75


def bm25(docs: DataFrame, key: str, fields: dict[str, float], terms: list[str], k: int) -> DataFrame:
    """The k best rows by BM25 (k1 1.2, b 0.75); a field's weight multiplies its term counts.

    Only the query's terms are shuffled: lengths come from array sizes in place, counts from a filter.
    """
    words = {c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "") for c in fields}
    split = docs.select(key, *(w.alias(f"words_{c}") for c, w in words.items()))  # once; what follows only counts
    is_term = lambda t: lambda x: x == t
    tf = [sum((F.size(F.filter(f"words_{c}", is_term(t))) * weight for c, weight in fields.items()), F.lit(0.0)) for t in terms]
    n_words = sum((F.size(f"words_{c}") for c in fields), F.lit(0))
    rows = cut(split.select(key, n_words.alias("n"), *(x.alias(f"tf{i}") for i, x in enumerate(tf))), "counts")
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hit = rows.filter(sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0.0)) > 0).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return hit.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def fuse(channels: list[tuple[DataFrame, float]], key: str, k: int = 60, most: int = 40) -> DataFrame:
    """Weighted reciprocal rank fusion of channels (key, rank from 0)."""
    rows = None
    for df, weight in channels:
        part = df.select(key, (F.lit(weight) / (k + F.col("rank") + 1)).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.round(F.sum("s"), 9).alias("score")).orderBy(F.desc("score"), key).limit(most)


def vector_top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    q = F.array(*map(F.lit, query))
    return vectors.select(key, F.round(identity.cosine(F.col(vector), q), 6).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)


def pack(rows: DataFrame, budget: int) -> DataFrame:
    """Greedy by score per token, skipping what no longer fits, then by score.

    Greedy is sequential, but of the rows of one cost it takes the first ones, at most budget / cost of them: once one
    does not fit, none after it does. Only these are candidates, found in shares of each cost first, as costs are few.
    """
    best = rows.withColumns({"density": F.col("score") / F.col("cost"), "share": F.pmod(F.xxhash64("symbol"), F.lit(256))})
    for keys in (["cost", "share"], ["cost"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("density"), "symbol"))
        best = best.withColumn("place", place).filter((F.col("cost") <= 0) | (F.col("place") * F.col("cost") <= budget))
    best = best.select("symbol", "score", "cost")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(density=pdf["score"] / pdf["cost"]).sort_values(["density", "symbol"], ascending=[False, True], kind="stable")
        left, keep = budget, []
        for cost in pdf["cost"]:
            keep.append(cost <= left)
            left -= cost * keep[-1]
        out = pdf[keep].sort_values(["score", "symbol"], ascending=[False, True])
        return out[["symbol", "score", "cost"]]

    return best.groupBy(F.lit("all")).applyInPandas(run, "symbol string, score double, cost long")


def pack_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    joined = old.select("symbol", F.lit(True).alias("o")).join(new.select("symbol", F.lit(True).alias("n")), "symbol", "full")
    return joined.select("symbol", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("unchanged").alias("change"))


def recall_memory(memory: DataFrame, words: list[str], now: int, newest: int = 50) -> DataFrame:
    """Of each word the newest matches; scores summed, older than a week weighing 7 / age."""
    asked = F.explode(F.array(*(F.lit(w) for w in words if len(w) >= 3)))
    hits = memory.select("id", "keywords", "symbol", "score", "at", asked.alias("word")).filter(F.contains(F.lower("keywords"), F.col("word")))
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("at"), F.desc("id")))).filter(F.col("k") <= newest)
    age = (F.lit(now) - F.col("at")) / 86_400
    return first.groupBy("symbol").agg(F.round(F.sum(F.col("score") * F.when(age <= 7, 1.0).otherwise(7 / age)), 6).alias("score"))
