"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Hash buckets of each n-gram order.
BUCKETS = 1 << 15
ORDERS = (2, 3)
#: Labelled documents that the model is fitted on, about; beyond it a hash of the id picks them.
TRAIN_DOCS = 20_000
#: More classes than this are refused: the matrix is broadcast.
MAX_LANGS = 256
_KEYS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_BLOCK = 4096
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams (orders x places), the rows' first places, and whether a row has letters.

    Letters are lower-cased, a run of anything else counts as one blank, a text starts and ends with a blank.
    """
    joined = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "replace"), np.uint32)
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in joined], out=offs[1:])
    letter = _letter_table()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[offs[:-1]] = True
    has = np.add.reduceat(letter, offs[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    places = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    codes, firsts = codes[keep], places[offs]
    before = np.empty_like(codes)
    before[1:], before[:1] = codes[:-1], 32
    earlier = np.empty_like(codes)
    earlier[2:], earlier[:2] = codes[:-2], 32
    two = codes * np.uint32(_KEYS[0]) + before * np.uint32(_KEYS[1])
    three = two + earlier * np.uint32(_KEYS[2])
    ids = [(h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17) for h in (two, three)]
    return np.stack([ids[0], ids[1] + np.uint32(BUCKETS)]).astype(np.int64), firsts, has


class Model:
    """Class names and their log-probability matrix (buckets x classes)."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, alpha: float = 0.1):
        self.langs = langs
        smooth = counts.reshape(len(langs), len(ORDERS), BUCKETS) + alpha
        logs = np.log(smooth) - np.log(smooth.sum(axis=2, keepdims=True))
        self.matrix = np.ascontiguousarray(logs.reshape(len(langs), -1).T, dtype=np.float32)
        self.prior = np.log((docs + 1) / (docs.sum() + len(docs))).astype(np.float64)

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Best class (und without letters) and its posterior, tempered to 50 n-grams so that it is not always 1."""
        ids, firsts, has = ngrams(texts)
        sums = np.zeros((len(texts), len(self.langs)), np.float64)
        for row in ids:
            sums += np.add.reduceat(self.matrix[row], firsts[:-1], axis=0, dtype=np.float64)
        n = np.diff(firsts)[:, None] * len(ORDERS)
        logits = sums * np.minimum(1.0, 50.0 / n) + self.prior
        best = (sums + self.prior).argmax(axis=1)
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        names = [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
        return names, np.where(has, p[np.arange(len(best)), best], 0.0)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Fit on labelled documents that are not held out; None if there are none."""
    spark = docs.sparkSession
    common.tune(spark)
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~common.held_out() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    index = {x: k for k, x in enumerate(langs)}
    width = len(ORDERS) * BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), width), np.int64)
        seen = np.zeros(len(langs), np.int64)
        for batch in batches:
            texts, names = batch.column(0), batch.column(1).to_pylist()
            for a, b in common.chunks(texts):
                ids, firsts, _ = ngrams(texts.slice(a, b - a).to_pylist())
                by = np.array([index[x] for x in names[a:b]])
                places = np.repeat(by, np.diff(firsts))
                for k in np.unique(by):
                    total[k] += np.bincount(ids[:, places == k].ravel(), minlength=width)
                    seen[k] += (by == k).sum()
        out = [(langs[k], at // _BLOCK, total[k, at : at + _BLOCK].astype("<i8").tobytes(), int(seen[k]) if not at else 0) for k in range(len(langs)) if seen[k] for at in range(0, width, _BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.int64()))], ["lang", "block", "counts", "seen"])

    def add(key, pdf):
        import pandas as pd

        got = sum(np.frombuffer(x, "<i8") for x in pdf["counts"])
        return pd.DataFrame({"lang": [key[0]], "block": [key[1]], "counts": [got.astype("<i8").tobytes()], "seen": [int(pdf["seen"].sum())]})

    schema = "lang string, block int, counts binary, seen long"
    some = rows.filter(common.sampled(sum(sizes.values()), train_docs, "doc_id")).select("text", "lang")
    parts = some.mapInArrow(common.tidy(count), schema).groupBy("lang", "block").applyInPandas(add, schema).collect()
    counts, seen = np.zeros((len(langs), width)), np.zeros(len(langs))
    for r in parts:
        counts[index[r["lang"]], r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], "<i8")
        seen[index[r["lang"]]] += r["seen"]
    return Model(langs, counts, seen)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with lang_pred string and lang_score double appended.

    Null texts and texts without a letter: `und` with score 0, as all texts without a model. Any columns may
    be there beside doc_id and text; columns of docs named lang_pred or lang_score are replaced.
    """
    spark: SparkSession = docs.sparkSession
    common.tune(spark)
    docs = docs.drop("lang_pred", "lang_score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            names, p = [], []
            for a, b in common.chunks(texts):
                x, y = m.score([t or "" for t in texts.slice(a, b - a).to_pylist()])
                names += x
                p.append(y)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(p) if p else [], pa.float64())], ["p", "s"])

    scored = F.arrow_udf(common.tidy(score), "p string, s double", F.ArrowUDFType.SCALAR_ITER)
    both = common.fresh(docs, "lang_both")
    return docs.withColumn(both, scored(F.col("text"))).withColumns({"lang_pred": F.col(both + ".p"), "lang_score": F.col(both + ".s")}).drop(both)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs))
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language can't be told (no text, no letter) go."""
    names = docs.columns
    return identify(docs, fit(docs)).filter(F.col("lang_pred") != "und").select(*names)
