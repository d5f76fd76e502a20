"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Words of a window, and from one window's start to the next: windows overlap by half, so a passage of up to 17 words
#: stands whole in one.
WINDOW, STRIDE = 32, 16
#: Labelled documents to learn from, about; and windows that one epoch goes through.
TRAIN_DOCS, EPOCH_WINDOWS, EPOCHS = 6_000, 16_000, 8
#: Bytes of text that come to the driver to learn from, about; a document of over a sixteenth of them is not learned from.
TRAIN_BYTES = 16 << 20
#: Words with an embedding of their own are those of most training documents; the others share one and differ by characters.
#: Windows of a step, and steps of a training at least.
BATCH, LEAST_STEPS = 256, 300
WORD_DROP, DECAY = 0.15, 1e-4
VOCABULARY, LEAST_DOCS = 20_000, 4
HIDDEN, WORD_DIM, CHAR_DIM, TRIGRAMS = 8, 8, 6, 4096
_LETTER_KEYS = common.mix64(np.arange(3 * 257, dtype=np.uint64) + np.uint64(77)).reshape(3, 257)


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of _soft where its value is y."""
    return np.square(1 - np.abs(y))


def trigrams(w: common.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams, ends marked, of the words at these places, and where each word's begin."""
    start, size = w.start[at], w.end[at] - w.start[at]
    first = np.zeros(len(at) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    place = np.arange(first[-1]) - np.repeat(first[:-1] - start, size)
    data = np.append(w.data, np.uint8(0)).astype(np.int64)
    low = np.where((data >= 0x41) & (data < 0x5B), data + 32, data)
    before, after = low[place - 1], low[np.minimum(place + 1, len(low) - 1)]
    before[first[:-1]] = 256
    after[first[1:] - 1] = 256
    mixed = _LETTER_KEYS[0][before] + _LETTER_KEYS[1][low[place]] + _LETTER_KEYS[2][after]
    return (common.mix64(mixed) >> np.uint64(52)).astype(np.int64), first


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of words (windows x WINDOW), which of them are words, and the rows' first windows. A row has one at least."""
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    firsts = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=firsts[1:])
    k = np.arange(firsts[-1]) - np.repeat(firsts[:-1], count)
    begin = np.repeat(first[:-1], count) + k * STRIDE
    places = begin.astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
    real = places < np.repeat(first[1:], count)[:, None]
    places[~real] = 0
    return places, real, firsts


class Net:
    """Parameters, the forward pass, and one pass back through time."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        self.vocabulary = vocabulary  # sorted keys; their number in it plus 1 is the embedding, 0 is any other word
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(max(2, s[0]))).astype(np.float32)
        self.p = {"word": (rng.standard_normal((len(vocabulary) + 1, WORD_DIM)) * 0.05).astype(np.float32), "char": (rng.standard_normal((TRIGRAMS, CHAR_DIM)) * 0.3).astype(np.float32), "att": make(2 * h), "out": make(2 * h), "bias": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {"x" + k: make(d, 3 * h), "c" + k: np.zeros(3 * h, np.float32), "u" + k: make(h, 3 * h)}
        self.shift = 0.0

    def ids(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == keys, at + 1, 0)

    def inputs(self, w: common.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all distinct words: embedding numbers, trigrams, their begins; and each word's number among the distinct ones."""
        keys, at, inverse = np.unique(w.key, return_index=True, return_inverse=True)
        grams, first = trigrams(w, at)
        return self.ids(keys), grams, first, inverse

    def vectors(self, ids: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(self.p["char"][grams], first[:-1], axis=0) / np.diff(first)[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][ids], chars], axis=1)

    def run(self, x: np.ndarray, which: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows; x: vectors of distinct words, which: their numbers (windows x WINDOW)."""
        p, h, n = self.p, HIDDEN, len(which)
        states = np.zeros((WINDOW, n, 2 * h), np.float32)
        mask = real.T.astype(np.float32)[:, :, None]
        for d, k in enumerate("fb"):
            table, u = x @ p["x" + k] + p["c" + k], p["u" + k]
            s = np.zeros((n, h), np.float32)
            steps = range(WINDOW) if k == "f" else range(WINDOW - 1, -1, -1)
            for t in steps:
                a, b = table[which[:, t]], s @ u
                zr = 0.5 + 0.5 * _soft(a[:, : 2 * h] + b[:, : 2 * h])
                c = _soft(a[:, 2 * h :] + zr[:, h:] * b[:, 2 * h :])
                new = (c + zr[:, :h] * (s - c)) * mask[t]
                if keep is not None:
                    keep.append((d, t, s, b, zr, c))
                s = new
                states[t, :, d * h : (d + 1) * h] = s
        e = np.where(mask[:, :, 0] > 0, states @ p["att"], np.float32(-30))
        e = np.exp(e - e.max(axis=0)) * mask[:, :, 0]
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        if keep is not None:
            keep.append((states, alpha, pooled, mask))
        return pooled @ p["out"] + p["bias"]

    def step(self, x, ids, grams, first, which, real, target, weight) -> dict:
        """Gradients of the weighted logistic loss over these windows."""
        p, h, kept = self.p, HIDDEN, []
        logit = self.run(x, which, real, kept)
        states, alpha, pooled, mask = kept.pop()
        g: dict = {}
        dl = ((1 / (1 + np.exp(-logit)) - target) * weight / weight.sum()).astype(np.float32)
        g["bias"], g["out"] = dl.sum(keepdims=True), pooled.T @ dl
        dp = dl[:, None] * p["out"]
        da = np.einsum("nh,tnh->tn", dp, states)
        de = alpha * (da - (alpha * da).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", de, states)
        ds = alpha[:, :, None] * dp + de[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for d, k in enumerate("fb"):
            table_grad, du, carry = np.zeros((len(x), 3 * h), np.float32), np.zeros_like(p["u" + k]), np.zeros((len(which), h), np.float32)
            for dd, t, s, b, zr, c in reversed(kept):
                if dd != d:
                    continue
                dn = (ds[t, :, d * h : (d + 1) * h] + carry) * mask[t]
                z, r = zr[:, :h], zr[:, h:]
                dc = dn * (1 - z) * _slope(c)
                dz = dn * (s - c) * 0.5 * _slope(2 * z - 1)
                dr = dc * b[:, 2 * h :] * 0.5 * _slope(2 * r - 1)
                dgate = np.concatenate([dz, dr, dc], axis=1)
                drec = np.concatenate([dz, dr, dc * r], axis=1)
                du += s.T @ drec
                carry = dn * z + drec @ p["u" + k].T
                np.add.at(table_grad, which[:, t], dgate)
            g["u" + k], g["x" + k], g["c" + k] = du, x.T @ table_grad, table_grad.sum(axis=0)
            dx += table_grad @ p["x" + k].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], ids, dx[:, :WORD_DIM])
        size = np.diff(first)
        np.add.at(g["char"], grams, np.repeat(dx[:, WORD_DIM:] / size[:, None], size, axis=0))
        return g

    def logits(self, col: pa.Array) -> np.ndarray:
        """Of each row the largest logit of its windows."""
        w = common.Words(col)
        ids, grams, first, inverse = self.inputs(w)
        x = self.vectors(ids, grams, first)
        places, real, firsts = windows(w.first)
        which = inverse[places] if len(inverse) else np.zeros(places.shape, np.int64)
        parts = [self.run(x, which[a : a + 8192], real[a : a + 8192]) for a in range(0, len(which), 8192)]
        return np.maximum.reduceat(np.concatenate(parts), firsts[:-1]).astype(np.float64)

    def score(self, col: pa.Array) -> np.ndarray:
        """0 to 1; equal texts get equal scores whatever stands beside them, up to rounding."""
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(col) - self.shift, -40, 40))), 6)


def distinct_words(col: pa.Array) -> tuple[np.ndarray, ...]:
    """Keys of all distinct words, each word's number among them, their trigrams and those's begins, the rows' first
    words; by chunks, so that only keys and trigrams of distinct words are held."""
    keys, numbers, grams, sizes, counts = [], [], [], [], []
    seen = np.zeros(0, np.uint64)
    for a, b in common.chunks(col):
        w = common.Words(col.slice(a, b - a))
        own, at = np.unique(w.key, return_index=True)
        fresh = ~np.isin(own, seen)
        tri, first = trigrams(w, at[fresh])
        keys.append(own[fresh])
        grams.append(tri.astype(np.int16))
        sizes.append(np.diff(first))
        counts.append(w.counts)
        numbers.append(w.key)
        seen = np.concatenate([seen, own[fresh]])
    order = np.argsort(seen, kind="stable")
    size = np.concatenate(sizes)
    first = np.concatenate([[0], np.cumsum(size)])
    grams = np.concatenate(grams)
    own = np.concatenate([[0], np.cumsum(size[order])])
    grams = grams[np.arange(own[-1]) + np.repeat(first[order] - own[:-1], size[order])]
    keys = seen[order]
    inverse = np.concatenate([np.searchsorted(keys, x).astype(np.int32) for x in numbers])
    return keys, inverse, grams.astype(np.int64), own, np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def train(col: pa.Array, toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Multiple-instance training: a toxic document's windows all count at first, later those that score highest."""
    keys, inverse, grams, first, doc_first = distinct_words(col)
    doc = np.repeat(np.arange(len(col), dtype=np.int64), np.diff(doc_first))
    pairs = np.unique(inverse * np.int64(len(col)) + doc)
    df = np.bincount(pairs // len(col), minlength=len(keys))
    del pairs, doc
    often = np.flatnonzero(df >= LEAST_DOCS)
    vocabulary = np.sort(keys[often[np.argsort(-df[often], kind="stable")[:VOCABULARY]]])
    net = Net(vocabulary, seed)
    ids = net.ids(keys)
    places, real, firsts = windows(doc_first)
    which = inverse[places]
    del places
    owner = np.repeat(np.arange(len(col), dtype=np.int32), np.diff(firsts))
    rng = np.random.default_rng(seed)
    target = toxic.astype(np.float32)[owner]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    pos, neg = np.flatnonzero(target > 0), np.flatnonzero(target == 0)
    # few windows make short epochs: as many more of them
    windows_each = min(len(pos), EPOCH_WINDOWS // 2) + min(len(neg), EPOCH_WINDOWS // 2)
    epochs = max(epochs, -(-LEAST_STEPS // -(-windows_each // BATCH)))
    done = 0
    for epoch in range(epochs):
        chosen = pos
        if epoch >= 2:  # the two best windows of each toxic document
            x = net.vectors(ids, grams, first)
            got = np.concatenate([net.run(x, which[pos[a : a + 8192]], real[pos[a : a + 8192]]) for a in range(0, len(pos), 8192)])
            order = np.lexsort((-got, owner[pos]))
            rank = np.arange(len(order)) - np.searchsorted(owner[pos][order], owner[pos][order], "left")
            chosen = pos[order[rank < 2]]
        half = EPOCH_WINDOWS // 2
        a = rng.choice(chosen, min(len(chosen), half), replace=False)
        b = rng.choice(neg, min(len(neg), half), replace=False)
        batch = rng.permutation(np.concatenate([a, b]))
        scale = np.float32(len(b) / max(1, len(a))) if epoch < 2 else np.float32(min(4.0, len(b) / max(1, len(a))))
        for at in range(0, len(batch), BATCH):
            rows = batch[at : at + BATCH]
            used, local = np.unique(which[rows], return_inverse=True)
            size = first[used + 1] - first[used]
            own = np.zeros(len(used) + 1, np.int64)
            np.cumsum(size, out=own[1:])
            tri = grams[np.arange(own[-1]) - np.repeat(own[:-1] - first[used], size)]
            seen = np.where(rng.random(len(used)) < WORD_DROP, 0, ids[used])
            x = net.vectors(seen, tri, own)
            g = net.step(x, seen, tri, own, local.reshape(len(rows), WINDOW), real[rows], target[rows], np.where(target[rows] > 0, scale, np.float32(1)))
            g["word"] += DECAY * net.p["word"]
            g["char"] += DECAY * net.p["char"]
            done += 1
            for k, v in net.p.items():
                m, s = state[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (np.square(g[k]) - s)
                v -= (0.01 if epoch < epochs - 2 else 0.003) * (m / (1 - 0.9**done)) / (np.sqrt(s / (1 - 0.99**done)) + 1e-7)
    got = np.concatenate([net.logits(col.slice(a, b - a)) for a, b in common.chunks(col)])
    order = np.argsort(-got, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, toxic.sum()))
    best = int(f1.argmax())
    low = got[order[best + 1]] if best + 1 < len(order) else got[order[best]] - 1
    net.shift = float((got[order[best]] + low) / 2)
    return net


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Net | None:
    """Fit on labelled documents that are not held out (about train_docs of them); None if one class is missing.

    Of several labels of a document the largest counts; null labels and texts are not learned from.
    """
    common.tune(docs.sparkSession)
    marks = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = marks.filter(common.sampled(marks.count(), train_docs, "doc_id"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= TRAIN_BYTES // 16)
    rows = common.cut(texts.join(picked, "doc_id").select("doc_id", "text", "toxic").distinct(), "labelled")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    some = rows.filter(common.sampled(size, TRAIN_BYTES, "doc_id", "text")) if size > TRAIN_BYTES else rows
    found = some.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    col, toxic = found.column("text").combine_chunks(), found.column("toxic").to_numpy().astype(np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    net = train(col, toxic)
    common.release()
    return net


def assess(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs with tox_score double (0 to 1; 0 for all without a model, a null text counts as empty) and tox_pred int."""
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.drop("tox_score", "tox_pred")
    if net is None:
        return docs.withColumns({"tox_score": F.lit(0.0), "tox_pred": F.lit(0)})
    shared = spark.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            parts = [model.score(texts.slice(a, b - a)) for a, b in common.chunks(texts)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    scored = F.arrow_udf(common.tidy(score), "double", F.ArrowUDFType.SCALAR_ITER)
    return docs.withColumn("tox_score", scored(F.col("text"))).withColumn("tox_pred", (F.col("tox_score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = assess(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out().alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_pred").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score as toxic go."""
    names = docs.columns
    return assess(docs, fit(docs, common.table(spark, sf_dir, "labels"))).filter(F.col("tox_score") < 0.5).select(*names)
