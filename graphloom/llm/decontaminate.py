"""Benchmark decontamination: a positional inverted index of the documents, probed for exact phrases and near ones."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Words of a window; a shorter item is one window.
WINDOW = 8
#: Bytes of text of one shard of the index.
SHARD_BYTES = 8 << 20
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is probed in blocks.
BLOCK_BYTES = 32 << 20
#: Words to either side of a window's rarest word within which its others make a near match.
SLOP = 16
INDEX_SCHEMA = "shard string, ids array<long>, n_words array<int>, terms binary, sizes binary, gaps binary"
HIT_SCHEMA = "shard string, place int, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>, near array<string>"


def build_index(docs: DataFrame) -> DataFrame:
    """Postings of all words of all documents: a row for each shard, its documents' ids and word counts, its sorted
    terms (64-bit hashes), their list lengths, and the positions in the shard as gaps. A null text has no words."""
    common.tune(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        counts: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            terms = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            order = np.argsort(terms, kind="stable")
            found, first, n = np.unique(terms[order], return_index=True, return_counts=True)
            gaps = np.diff(order, prepend=0)
            gaps[first] = order[first]
            row = [uuid.uuid4().hex], [ids], [np.concatenate(counts).astype(np.int32)], [found.tobytes()], [n.astype("<u4").tobytes()], [gaps.astype("<u4").tobytes()]
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["shard", "ids", "n_words", "terms", "sizes", "gaps"])

        for batch in batches:
            texts = batch.column(1)
            for a, b in common.chunks(texts):
                part = texts.slice(a, b - a)
                w = common.Words(part)
                ids += batch.column(0).slice(a, b - a).to_pylist()
                counts.append(w.counts)
                keys.append(w.key)
                size += len(w.data) + 64 * (b - a)
                if size >= SHARD_BYTES:
                    yield shard()
                    ids, counts, keys, size = [], [], [], 0
        if ids:
            yield shard()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(build), INDEX_SCHEMA)


class Probe:
    """Distinct windows of benchmark items, as numbers of their distinct words."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        seen: dict[bytes, int] = {}
        pairs: set[tuple[int, int]] = set()
        self.names = sorted({name for name, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        rows, sizes = [], []
        for name, text in items:
            keys = common.word_keys(text)
            n = min(window, len(keys))
            for at in range(len(keys) - n + 1 if n else 0):
                got = keys[at : at + n]
                k = seen.setdefault(got.tobytes(), len(seen))
                if k == len(rows):
                    rows.append(np.concatenate([got, np.zeros(window - n, np.uint64)]))
                    sizes.append(n)
                pairs.add((k, number[name]))
        self.size = np.array(sizes, np.int64)
        all_keys = np.array(rows, np.uint64).reshape(len(rows), window)
        self.terms, inverse = np.unique(all_keys, return_inverse=True)
        self.words = inverse.reshape(len(rows), window)
        ordered = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.item = ordered[:, 1]
        self.item_first = np.searchsorted(ordered[:, 0], np.arange(len(rows) + 1))

    def search(self, terms: np.ndarray, sizes: np.ndarray, positions: np.ndarray, doc_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Exact matches (window, start) and near ones (window, place of its rarest word) in a shard."""
        none = np.zeros(0, np.int64)
        if not len(self.size) or not len(terms):
            return none, none, none, none
        lists = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        have = terms[at] == self.terms
        n = np.where(have, sizes[at], 0).astype(np.int64)
        begin = lists[at]
        own = np.concatenate([[0], np.cumsum(n)])
        pick = np.arange(own[-1]) - np.repeat(own[:-1] - begin, n)
        posts = (np.repeat(np.arange(len(n)), n) << 40) | positions[pick]  # all postings of benchmark words, in order
        width = self.words.shape[1]
        inside = np.arange(width) < self.size[:, None]
        freq = np.where(inside, n[self.words], np.iinfo(np.int64).max)
        rare = freq.argmin(axis=1)
        least = freq[np.arange(len(freq)), rare]
        live = np.flatnonzero(least > 0)
        exact_w, exact_at, near_w, near_at = [], [], [], []
        for part in np.array_split(live, 1 + int(least[live].sum() // 2_000_000)):
            reps = least[part]
            w = np.repeat(part, reps)
            first = own[self.words[part, rare[part]]]
            k = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps - first, reps)
            anchor = posts[k] & ((1 << 40) - 1)
            doc = np.searchsorted(doc_first, anchor, "right") - 1
            low, high = doc_first[doc], doc_first[doc + 1]
            near = np.ones(len(w), bool)
            start = anchor - rare[w]
            good = (start >= low) & (start + self.size[w] <= high)
            for j in range(width):
                use = j < self.size[w]
                term = self.words[w, j] << 40
                rows = np.flatnonzero(use & good)
                key = term[rows] | (start[rows] + j)
                place = np.minimum(np.searchsorted(posts, key), len(posts) - 1)
                good[rows] = posts[place] == key
                rows = np.flatnonzero(use & near)
                place = np.searchsorted(posts, term[rows] | np.maximum(low[rows], anchor[rows] - SLOP))
                found = posts[np.minimum(place, len(posts) - 1)]
                near[rows] = (place < len(posts)) & (found <= (term[rows] | np.minimum(high[rows] - 1, anchor[rows] + SLOP)))
            exact_w.append(w[good])
            exact_at.append(start[good])
            near_w.append(w[near])
            near_at.append(anchor[near])
        return tuple(np.concatenate(x) if x else none for x in (exact_w, exact_at, near_w, near_at))

    def items_of(self, window: np.ndarray, at: np.ndarray, doc_first: np.ndarray) -> dict[int, list[str]]:
        """Sorted names of the items of these windows, by document."""
        n = self.item_first[window + 1] - self.item_first[window]
        item = self.item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.item_first[window], n)]
        doc = np.repeat(np.searchsorted(doc_first, at, "right") - 1, n)
        out: dict[int, list[str]] = {}
        for x in np.unique(doc * max(1, len(self.names)) + item):
            out.setdefault(int(x) // len(self.names), []).append(self.names[int(x) % len(self.names)])
        return out


def spans_of(window: np.ndarray, start: np.ndarray, size: np.ndarray, doc_first: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Merged word spans, from 0 in each document, that any match covers."""
    out: dict[int, list[tuple[int, int]]] = {}
    order = np.argsort(start, kind="stable")
    doc = np.searchsorted(doc_first, start, "right") - 1
    for k in order:
        d, a, b = int(doc[k]), int(start[k] - doc_first[doc[k]]), int(start[k] - doc_first[doc[k]] + size[window[k]])
        spans = out.setdefault(d, [])
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return out


def probe(index: DataFrame, items: list[tuple[str, str]], window: int = WINDOW) -> DataFrame:
    """A row for each document of the index with its spans and items."""
    return _probe(index, index.sparkSession.sparkContext.broadcast(Probe(items, window)))


def _probe(index: DataFrame, shared: Broadcast) -> DataFrame:

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Probe = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard, ids, n_words, terms, sizes, gaps = (c[row].as_py() if i < 3 else np.frombuffer(c[row].as_buffer(), "<u8" if i == 3 else "<u4") for i, c in enumerate(batch.columns))
                lists = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                sums = np.cumsum(gaps.astype(np.int64))
                positions = sums - np.repeat(np.concatenate([[0], sums])[lists[:-1]], sizes)
                doc_first = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
                w, start, nw, near = p.search(terms, sizes, positions, doc_first)
                spans, items_of, near_of = spans_of(w, start, p.size, doc_first), p.items_of(w, start, doc_first), p.items_of(nw, near, doc_first)
                n = len(ids)
                columns = [[shard] * n, list(range(n)), ids, n_words, [[{"start": a, "stop": b} for a, b in spans.get(k, ())] for k in range(n)], [items_of.get(k, []) for k in range(n)], [near_of.get(k, []) for k in range(n)]]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["shard", "place", "doc_id", "n_words", "spans", "items", "near"])

    return index.mapInArrow(common.tidy(search), HIT_SCHEMA)


def _merge(key, pdf):
    import pandas as pd

    spans: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for x in pdf["spans"] for s in x):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    lists = {k: sorted({i for x in pdf[k] for i in x}) for k in ("items", "near")}
    return pd.DataFrame([{"shard": key[0], "place": key[1], "doc_id": pdf["doc_id"].iloc[0], "n_words": pdf["n_words"].iloc[0], "spans": [{"start": a, "stop": b} for a, b in spans], **lists}])


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items (sorted as strings), near (items whose
    window's words lie close together, in any order), spans (words that occurrences cover).

    Null and empty texts have no words; items with no words or a null id have no windows; several rows of one
    item are one item; repeated documents are each judged; an empty benchmark hits nothing.
    """
    index = common.cut(build_index(docs), "index")
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    if blocks == 1:
        found = probe(index, [tuple(r) for r in bench.collect()], window)
    else:  # one block after the other, so that no more than one is held by the driver and the executors
        found = None
        for k in range(blocks):
            items = [tuple(r) for r in bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]
            shared = index.sparkSession.sparkContext.broadcast(Probe(items, window))
            part = common.cut(_probe(index, shared), "probed")
            shared.destroy()
            found = part if found is None else found.unionByName(part)
        found = found.groupBy("shard", "place").applyInPandas(_merge, HIT_SCHEMA)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "near", "spans")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


#: Words of a whole window: with so many hit, one item is enough for the pipeline, since items are copied one by one.
LEAST_HIT = 8
LEAKED = f"n_items >= 2 or n_hit >= {LEAST_HIT}"


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which windows of two benchmark items occur, or LEAST_HIT words of windows, go.

    A decision is on an id and its text: rows without id, and the texts of an id that stands on several, are each judged.
    """
    key = common.fresh(docs, "key")
    rows = docs.withColumn(key, common.text_key())
    found = find(rows.select(F.col(key).alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    leaks = common.cut(found.filter(LEAKED).select(F.col("doc_id").alias(key)), "leaks").distinct()
    return common.with_ids(rows, leaks, "left_anti", key).select(*docs.columns)


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[s : s + least(8, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, s, sizes.n, array_to_string(w[s : s + sizes.n - 1], ' ') AS win
       FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d), sizes WHERE s + sizes.n - 1 <= len(w)),
hits AS (SELECT DISTINCT r, s, dw.n, item_id FROM dw JOIN bw ON bw.win = dw.win AND bw.n = dw.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
