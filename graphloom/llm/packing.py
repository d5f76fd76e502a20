"""Best-fit packing of tokenised documents, with lower bounds by dual-feasible functions and repacking over groups."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

CAPACITY = 2048
#: Pieces of one group, about, that are packed together before groups exchange.
GROUP = 1500
#: Rounds of exchange at most; each leaves a small share of the former one's pieces open.
ROUNDS = 12
#: Runs whose ids a worker remembers before it starts anew.
REMEMBERED = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Kinds of bytes: blanks, letters (ASCII, and the pairs that begin with 0xC3), digits, other ASCII.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 13, 32]] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
#: Bytes that make a word odd: apostrophes (contractions), control bytes, and what begins other characters than U+00C0 to U+00FF.
_ODD = np.zeros(256, bool)
_ODD[[*range(9), 11, 12, *range(14, 32), 0x27, 0x7F, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """The tokenizer's ids of texts.

    The tokenizer lower-cases, parts a text at white space, and a word into runs of letters, single digits and
    runs of other characters, whose ids do not depend on what stands around them. So each run's ids are found
    once and remembered. Words that hold anything but ASCII and U+00C0 to U+00FF, an apostrophe (contractions) or
    the begin of a special token go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # the same object, not a copy
        self.letters = {b: x for b, x in enumerate(_byte_letters()) if b >= 0x80}
        self.clear()

    def clear(self) -> None:
        self.runs: dict[int, int] = {}  # a run's key, and its number in `first`
        self.ids, self.first = array("I"), array("q", [0])

    def add(self, run: bytes, odd: bool) -> int:
        """Append the ids of a new run; its number."""
        if odd:
            self.ids.extend(self.tokenizer.encode(run.decode(), add_special_tokens=False).ids)
        else:
            self.ids.extend([t.id for t in self.model.tokenize(run.decode() if run.isascii() else run.decode("latin-1").translate(self.letters))])
        self.first.append(len(self.ids))
        return len(self.first) - 2

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row's followed by a 0, and where each row's begin."""
        if len(self.runs) > REMEMBERED:
            self.clear()
        data, offs = common.raw_bytes(col)
        n = len(data)
        kind = np.zeros(n + 2, np.uint8)
        kind[1:-1] = _KIND[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        ink = kind > 0
        word_start = np.flatnonzero(ink[1:-1] & (~ink[:-2] | edge[:-1]))
        word_end = np.flatnonzero(ink[1:-1] & (~ink[2:] | edge[1:])) + 1
        odd = _ODD[data]
        after_c3 = np.zeros(n, bool)
        after_c3[1:] = data[:-1] == 0xC3
        odd |= after_c3 & ((data == 0x97) | (data == 0xB7))
        odd[1:] |= (data[1:] == 0x7C) & (data[:-1] == 0x3C)
        odds = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
        odd_words = np.flatnonzero(odds[word_end] > odds[word_start])
        inside = np.zeros(n + 1, np.int8)
        inside[word_start[odd_words]] += 1
        np.add.at(inside, word_end[odd_words], -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        low = common.LOWER[data]
        low[after_c3 & (data < 0x9F) & (data != 0x97)] += 0x20
        low[inside] = data[inside]
        parts = np.zeros(n + 1, bool)
        parts[1:-1] = ((kind[1:-2] != kind[2:-1]) | (kind[2:-1] == 2)) & ~inside[1:]
        parts |= edge
        parts[word_start] = parts[word_end] = True
        start = np.flatnonzero(parts[:-1] & ink[1:-1])
        end = np.flatnonzero(parts[1:] & ink[1:-1]) + 1
        key = common.span_keys(low, start, end)
        keys, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        keys = keys.tolist()
        numbers = list(map(self.runs.get, keys))
        text = low.tobytes()
        for k, number in enumerate(numbers):
            if number is None:
                a = start[at[k]]
                numbers[k] = self.runs[keys[k]] = self.add(text[a : end[at[k]]], inside[a])
        ids, first = np.frombuffer(self.ids, "<u4"), np.frombuffer(self.first, "<i8")
        number = np.array(numbers, np.int64)[inverse] if len(keys) else np.zeros(0, np.int64)
        size = first[number + 1] - first[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        run_first = np.searchsorted(start, offs)
        row_first = ends[run_first] + np.arange(len(offs))  # a 0 stands after each row
        out = np.zeros(row_first[-1], "<u4")
        if len(number):
            place = np.arange(ends[-1])
            row = np.repeat(np.arange(len(offs) - 1), np.diff(ends[run_first]))
            out[place + row] = ids[place + np.repeat(first[number] - ends[:-1], size)]
        return out, row_first


def encoder(path: str) -> Encoder:
    """One for each worker process: reading the file takes longer than most batches."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids of each document (its ids and one 0); a null text is an empty one."""
    common.tune(docs.sparkSession)
    path = path or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in common.chunks(texts):
                rows = []
                ids, first = known.encode(texts.slice(a, b - a))
                for doc, lo, hi in zip(batch.column(0).slice(a, b - a).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    rows += [(doc, k, at - lo, min(capacity, hi - at), zlib.crc32(ids[at : min(at + capacity, hi)])) for k, at in enumerate(range(lo, hi, capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(encode), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that these lengths need at least: the best of two families of dual-feasible functions.

    f_e counts lengths over capacity - e as whole bins and those under e as nothing; u_k rounds (k + 1) x down
    to whole numbers where it isn't one, then divides by k.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    count, weight = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    e = np.arange(0, capacity // 2 + 1)
    whole = count[-1] - count[capacity - e + 1]
    middle = weight[capacity - e + 1] - weight[e]
    best = int((whole + -(-middle // capacity)).max())
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)  # times k
        best = max(best, int(-(-(n * value).sum() // (capacity * k))))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's bin and offset, and the bins' fill."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k in order.tolist():
        need = int(lengths[k])
        fit = mask >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += need
        left = room - need
        by_room[left].append(b)
        if left:
            mask |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


ROUND = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, done boolean"


def _pack(number: int, last: bool, capacity: int):
    def pack(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        open_ = np.zeros(len(fill), bool)
        if not last:  # a group within its bound can gain by one bin at most, one with a gap by more
            gap = len(fill) - lower_bound(lengths, capacity)
            loose = np.argsort(fill, kind="stable")[: 2 * (gap + 1)]
            open_[loose] = fill[loose] < 0.995 * capacity
        out = pdf.drop(columns=["grp"])
        out["sequence_id"] = (number << 58) + (int(key[0]) << 22) + bins
        out["offset"], out["done"] = offsets, ~open_[bins]
        return out

    return pack


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (see pieces) with sequence_id and offset, in as few sequences as rounds of repacking reach.

    Groups of about GROUP pieces, dealt by a hash, are packed best-fit decreasing. A lower bound certifies each
    group's number of bins; the loosest bins, more of them where there is a gap, are opened, and their pieces
    dealt to fewer groups and packed again, until one group is left.
    """
    spark = parts.sparkSession
    todo, out, n = parts, None, parts.count()
    for number in range(ROUNDS):
        groups = max(1, -(-n // GROUP))
        last = groups == 1 or number == ROUNDS - 1
        dealt = todo.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
        packed = common.cut(dealt.groupBy("grp").applyInPandas(_pack(number, last, capacity), ROUND), "packed")
        done = packed.filter("done")
        out = done if out is None else out.unionByName(done)
        todo = packed.filter("not done").drop("sequence_id", "offset", "done")
        n = 0 if last else todo.count()
        if not n:
            break
    return out.drop("done") if out is not None else spark.createDataFrame([], ROUND).drop("done")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.cut(pieces(common.table(spark, sf_dir, "documents")), "pieces"))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the kept documents' pieces and their places."""
    return pack(common.cut(pieces(docs), "pieces"))
