"""Shared pieces of the training-data operators: tables in the shared folder, word scanning, joins on skewed keys."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20
#: Rows of one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is made only where it is unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it again: lost executors recompute from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system: a worker process serves many stages, and its allocators keep what they had."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches, then release()."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sampled(rows: int, expected: int, *key: str):
    """A condition that keeps about `expected` of `rows` rows, picked by a hash of the key columns."""
    share = min(1.0, expected / max(1, rows))
    return F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(1 << 30)) < int(share * (1 << 30))


# ---------------------------------------------------------------- words


def _mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mix64 = _mix64
_BASE = 0x9E3779B97F4A7C13  # odd, and 3 mod 8
_INVERSE = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x41:0x5B] = _WORD[0x80:] = True
_CASED_KEYS = _mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_KEYS = _CASED_KEYS[LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without a copy, and its n + 1 offsets; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        width = np.int64
    else:
        col = col.cast(pa.string())
        width = np.int32
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or not len(offs):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array of at most `limit` bytes each, or of one row."""
    _, offs = raw_bytes(col)
    at, n = 0, len(col)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, byte_keys: np.ndarray = _CASED_KEYS) -> np.ndarray:
    """64-bit hashes of the bytes from start to end."""
    n = len(data)
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_keys[data] * up[:n], out=sums[1:])
    return _mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of a string array: lower-cased A-Z, words are runs of 0-9, a-z and anything beyond ASCII.

    first[d]..first[d + 1] are the words of row d; start and end are byte places; key is a 64-bit hash
    (two words differ in it but for a chance of some 1e-19 a pair).
    """

    def __init__(self, col: pa.Array):
        data, offs = raw_bytes(col)
        n = len(data)
        self.data, self.offs = data, offs
        is_word = np.zeros(n + 1, bool)
        is_word[:n] = _WORD[data]
        begins = is_word[:n].copy()
        begins[1:] &= ~is_word[: n - 1] if n > 1 else True
        edges = offs[:-1][offs[:-1] < n]
        begins[edges] = is_word[edges]
        ends = is_word[:n] & ~is_word[1:]
        last = offs[1:][offs[1:] > 0] - 1
        ends[last] = is_word[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs).astype(np.int64)
        self.key = span_keys(data, self.start, self.end, _BYTE_KEYS)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def word_keys(text: str) -> np.ndarray:
    return Words(pa.array([text])).key


# ---------------------------------------------------------------- skew


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], counts: str, how: str = "inner", parts: int = 256) -> DataFrame:
    """left joined to right, which has one row for each key and the key's number of left rows in column `counts`.

    Keys that hold over 1/parts of all left rows (about `parts` of them at most, so that their hashes make a list of
    literals and their rows a broadcast) are looked up where they lie; only the others are shuffled, so that no key
    makes a large task.
    """
    total = right.agg(F.sum(counts)).first()[0] or 0
    digest = F.xxhash64(*(F.col(k).cast(right.schema[k].dataType) for k in keys))
    marks = [r[0] for r in right.filter(F.col(counts) >= max(2, total // parts)).select(digest).collect()] if total else []
    if not marks:
        return left.join(right, keys, how)
    hot = digest.isin(marks)  # a key that shares a hash by chance is looked up too
    cold = left.filter(~hot).join(right.filter(~hot), keys, how)
    near = left.filter(hot).join(F.broadcast(right.filter(hot)), keys, how)
    return cold.unionByName(near)


#: Ids that may be broadcast: 8 bytes each and as much again for their table. More are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def with_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """docs left_semi or left_anti the distinct ids; broadcast only after counting them. A null id is no id: left_anti
    keeps its rows, so a decision on rows without id goes by text_key."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, key, how)


def text_key():
    """A 64-bit hash of a row's id and text, for rows whose id is null or stands on several texts."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return F.xxhash64(F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), F.coalesce(text, F.lit("")), text.isNull())


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
