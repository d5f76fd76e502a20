"""Whether one ranking is better than another, and vector search for many queries at once."""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wilcoxon(differences: list[float]) -> float:
    """Two-sided p of the signed ranks, by the normal approximation; equal sizes rank in the order given; 1 without any."""
    d = sorted((x for x in differences if x), key=abs)
    n = len(d)
    if not n:
        return 1.0
    plus = sum(k for k, x in enumerate(d, 1) if x > 0)
    z = (plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return math.erfc(abs(z) / math.sqrt(2))


def cohens_d(differences: list[float]) -> float:
    """Mean over standard deviation (n - 1); 10 or -10 where all are the same, 0 where they are none or all 0."""
    n = len(differences)
    if not n:
        return 0.0
    mean = sum(differences) / n
    spread = math.sqrt(sum((x - mean) ** 2 for x in differences) / (n - 1)) if n > 1 else 0.0
    return mean / spread if spread >= 1e-10 else math.copysign(10.0, mean) if mean else 0.0


def bootstrap(values: list[float], times: int = 1000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """An interval for the mean from resampled means."""
    if not values:
        return 0.0, 0.0
    rng = random.Random(seed)
    means = sorted(sum(rng.choices(values, k=len(values))) / len(values) for _ in range(times))
    return means[min(times - 1, int(times * alpha / 2))], means[min(times - 1, int(times * (1 - alpha / 2)))]


def compare(metrics: DataFrame, one: str, other: str) -> DataFrame:
    """n, mean difference, p and effect of two columns of a table with a row a query (a benchmark has some hundreds)."""
    d = [r[0] - r[1] for r in metrics.orderBy("query").select(one, other).collect()]
    low, high = bootstrap(d)
    row = (len(d), sum(d) / max(1, len(d)), wilcoxon(d), cohens_d(d), low, high)
    return metrics.sparkSession.createDataFrame([row], "n long, mean double, p double, effect double, low double, high double")


#: Queries that go to the executors at once; more go in several passes.
BLOCK = 4096


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, key, cosine, rank from 0): for each query vector the k best of all vectors, ties to the lesser key; exact.

    vectors and queries: key long, vector array<float>. Queries are sent in blocks; each task keeps the k best it has
    seen of each query, so what is shuffled is tasks x queries x k rows. Vectors of another length or without length
    have cosine 0.
    """
    spark = vectors.sparkSession
    known = queries.select(F.col("key").cast("long"), "vector").filter("key is not null and vector is not null")
    blocks = max(1, -(-known.count() // BLOCK))
    out = None
    for b in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()  # BLOCK rows, about
        width = max((len(r["vector"]) for r in rows), default=1)
        q = np.array([r["vector"] if len(r["vector"]) == width else [0.0] * width for r in rows], np.float64).reshape(len(rows), width)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((np.array([r["key"] for r in rows], np.int64), q))

        def search(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            best: list[list] = [[] for _ in ids]
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                x = np.array([v if v is not None and len(v) == width else [0.0] * width for v in batch.column(1).to_pylist()], np.float64).reshape(len(keys), width)
                score = np.round(asked @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T, 6)
                for j in range(len(ids)):
                    first = np.lexsort((keys, -score[j]))[:k]
                    best[j] = heapq.nsmallest(k, best[j] + [(-score[j][i], int(keys[i])) for i in first])
            flat = [(int(ids[j]), key, -s) for j in range(len(ids)) for s, key in best[j]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int64()), pa.array([r[2] for r in flat], pa.float64())], ["query", "key", "cosine"])

        part = vectors.select(F.col("key").cast("long"), "vector").filter("key is not null").mapInArrow(search, "query long, key long, cosine double")
        out = part if out is None else out.unionByName(part)
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "key")) - 1
    return out.withColumn("rank", rank).filter(F.col("rank") < k)
