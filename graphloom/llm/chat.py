"""Chat formatting: a hidden Markov model over line features finds who speaks, then turns are written canonically."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Hidden states; a turn's first line is told from its other lines by a feature, so a state is a speaker.
ROLES = ("system", "user", "assistant")
# What may stand before a colon, or within role tags, at the start of a line, and whom it names.
MARKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "prompt", "you"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "gpt", "model"),
}
_NAMED = {name: k for k, role in enumerate(ROLES) for name in MARKERS[role]}
_MARKER = re.compile(r"^\s*(?:(?:#{1,4}|\*\*|>|<\|im_start\|>|<\|start_header_id\|>|<\|)?\s*([A-Za-z]{1,12})\s*(?:\*\*)?\s*(?::|\|>|<\|end_header_id\|>)|<\|im_start\|>\s*([A-Za-z]{1,12})\s*$|\[(INST|SYS)\]|#{1,4}\s*([A-Za-z]{1,12})\s*$)\s*", re.ASCII)
#: Line features: the marker (none, or whom it names); whether the line opens a row, and which (first, second, later);
#: length in words, by powers of two; how it ends; its first word, hashed.
N_MARKERS, N_OPENS, N_PLACES, N_LENGTHS, N_ENDS, N_FIRST = 4, 2, 3, 6, 3, 64
_SIZES = (N_MARKERS, N_OPENS * N_PLACES, N_LENGTHS, N_ENDS, N_FIRST)
_AT = [sum(_SIZES[:k]) for k in range(len(_SIZES))]
N_FEATURES = sum(_SIZES)
#: Rows of one block of a conversation: longer ones are decoded in blocks whose ends are then joined.
BLOCK = 512
#: Rows with a role that the model is fitted on, about.
TRAIN_ROWS = 50_000
SMOOTH = 0.5


def marker(line: str) -> tuple[int, int]:
    """0, or 1 + the role that a marker at the line's start names, and where the rest begins."""
    if (m := _MARKER.match(line)) is None:
        return 0, 0
    if m[3]:
        return (2 if m[3] == "INST" else 1), m.end()
    role = _NAMED.get((m[1] or m[2] or m[4]).lower())
    return (0, 0) if role is None else (1 + role, m.end())


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def features(line: str, opens: bool, place: int) -> list[int]:
    """Numbers of the line's features; place is its row's number in the conversation."""
    mark, begin = marker(line)
    words = line[begin:].split()
    last = 0 if not words else 1 if words[-1][-1] in "?¿？" else 2
    first = zlib.crc32(words[0].lower().encode()) % N_FIRST if words else 0
    found = (mark, opens * N_PLACES + min(place, N_PLACES - 1), min(N_LENGTHS - 1, len(words).bit_length()), last, first)
    return [a + x for a, x in zip(_AT, found, strict=True)]


class Hmm:
    """Log-probabilities of starts, of changes between lines of a row (stay) and between rows, and of features."""

    def __init__(self, emit: np.ndarray, change: np.ndarray, start: np.ndarray, within: float = 0.02):
        groups = np.split(np.arange(N_FEATURES), _AT[1:])
        self.emit = np.zeros((N_FEATURES, len(ROLES)))
        for g in groups:
            pooled = (emit[g].sum(axis=1) + SMOOTH) / (emit[g].sum() + SMOOTH * len(g))
            own = (emit[g] + SMOOTH * len(g) * pooled[:, None]) / (emit[g].sum(axis=0) + SMOOTH * len(g))
            self.emit[g] = np.log(0.95 * own + 0.05 * pooled[:, None])  # what a role never did is unlikely, not excluded
        self.emit[1:N_MARKERS] = np.log(np.where(np.eye(len(ROLES)) > 0, 1 - 2e-6, 1e-6))  # what a marker says holds, seen or not
        self.emit[0] = 0.0
        self.start = np.log((start + SMOOTH) / (start + SMOOTH).sum())
        self.between = np.log((change + SMOOTH) / (change + SMOOTH).sum(axis=1, keepdims=True))
        n = len(ROLES)
        self.within = np.log(np.where(np.eye(n) > 0, 1 - within * (n - 1), within))

    def score(self, text: str, place: int) -> np.ndarray:
        """Emission scores of a row's lines (lines x roles)."""
        rows = [features(x, k == 0, place) for k, x in enumerate(lines_of(text))]
        return self.emit[np.array(rows)].sum(axis=1)


def viterbi(scores: np.ndarray, opens: np.ndarray, hmm: Hmm, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score of each last state, and back-pointers (lines x roles); before: scores at the state ahead of the first."""
    best, back = before, np.zeros(scores.shape, np.int8)
    for t in range(len(scores)):
        step = best[:, None] + (hmm.between if opens[t] else hmm.within)
        back[t] = step.argmax(axis=0)
        best = step.max(axis=0) + scores[t]
    return best, back


def trace(back: np.ndarray, last: int) -> np.ndarray:
    out = np.zeros(len(back) + 1, np.int64)
    out[-1] = last
    for t in range(len(back) - 1, -1, -1):
        out[t] = back[t, out[t + 1]]
    return out


def fit(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> Hmm:
    """Counts of features and changes over conversations, picked by a hash of conv_id, whose rows all name a role."""
    known = rows.filter(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull())
    some = known.filter(common.sampled(known.count(), train_rows, "conv_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_FEATURES, len(ROLES)), np.int64)
        for batch in batches:
            for role, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, line in enumerate(lines_of(text or "")):
                    total[features(line, k == 0, place), ROLES.index(role)] += 1
        at = np.argwhere(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(total[at[:, 0], at[:, 1]], pa.int64())], ["f", "r", "n"])

    emit, change, start = np.zeros((N_FEATURES, len(ROLES))), np.zeros((len(ROLES),) * 2), np.zeros(len(ROLES))
    for f, r, n in some.select("role", F.least(F.col("place"), F.lit(1000)).cast("int").alias("place"), "text").mapInArrow(common.tidy(count), "f int, r int, n long").groupBy("f", "r").agg(F.sum("n")).collect():
        emit[f, r] += n
    for a, b, n in some.filter("former is not null").groupBy("former", "role").count().collect():
        if a in ROLES:
            change[ROLES.index(a), ROLES.index(b)] += n
    for a, n in some.filter("place = 0").groupBy("role").count().collect():
        start[ROLES.index(a)] += n
    return Hmm(emit, change, start)


OUT = "conv_id long, turn long, role string, place long, role_pred string, n_rows long, n_lines int, n_switches int, rendered string"


def _placed(rows: DataFrame) -> DataFrame:
    """rows with place (from 0 in their conversation), part (its block) and former (the role before).

    Rows are dealt by ranges of their order, so a conversation of any size, also one whose turns are all equal or null,
    lies in as many tasks as it needs; a range's first conversation is told how many of its rows lie before.
    """
    order = ["turn", "role", "th"]
    known = rows.filter("conv_id is not null").withColumn("th", F.xxhash64("text"))
    ranged = common.cut(known.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "turns")
    sizes = ranged.groupBy("range", "conv_id").agg(F.count("*").alias("n"), F.max_by("role", F.struct(*order)).alias("last"))
    on = sizes.selectExpr("range", "conv_id", "sum(n) over (partition by conv_id order by range rows between unbounded preceding and 1 preceding) as ahead", "lag(last) over (partition by conv_id order by range) as last")
    here = "over (partition by range, conv_id order by turn, role, th)"
    own = ranged.selectExpr("*", f"row_number() {here} - 1 as at", f"lag(role) {here} as before")
    own = own.join(F.broadcast(on.filter("ahead > 0")), ["range", "conv_id"], "left")  # at most one a range
    place = (F.col("at") + F.coalesce("ahead", F.lit(0))).cast("long")
    own = own.withColumns({"place": place, "former": F.when(F.col("at") == 0, F.col("last")).otherwise(F.col("before"))})
    own = own.withColumn("part", F.floor(F.col("place") / BLOCK).cast("long"))
    columns = [*rows.columns, "part", "place", "former"]
    alone = rows.filter("conv_id is null").withColumns({"former": F.lit(None).cast("string"), "place": F.lit(0).cast("long"), "part": F.lit(0).cast("long")})
    return common.cut(own.select(columns).unionByName(alone.select(columns)), "placed")


def format_chats(conversations: DataFrame) -> DataFrame:
    """A row for each distinct row: its recovered role, lines, changes of speaker within it, and canonical text.

    The canonical text has `<|role|>` on a line, the turn's lines without markers and outer blanks, and
    `<|end|>` on a line; a row in which the speaker changes is written as several turns. role_pred is the first
    line's speaker. Equal rows are one row with their number in n_rows. A conversation is its rows by turn (nulls first, then by role
    and a hash of the text);
    rows without conv_id are conversations of their own; null texts are empty ones; unknown or null roles are only
    not learned from.
    """
    spark = conversations.sparkSession
    common.tune(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n_rows"))
    rows = _placed(rows)
    shared = spark.sparkContext.broadcast(fit(rows))
    keyed = rows.withColumn("key", F.when(F.col("conv_id").isNull(), F.xxhash64(F.lit("alone"), "turn", "role", "text")).otherwise(F.xxhash64("conv_id", "part")))
    keyed = keyed.select("key", "conv_id", "part", "turn", "role", "text", "n_rows", "place").repartition("key").sortWithinPartitions("key", "conv_id", "part", "place")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        """Whole (conv_id, part) groups of a sorted partition."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            pdf = batch.to_pandas()
            edges = np.flatnonzero((pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1])) + 1
            pieces = np.split(np.arange(len(pdf)), edges)
            for k, piece in enumerate(pieces):
                part = pdf.iloc[piece]
                if held and (k or held[-1]["key"].iloc[-1] != part["key"].iloc[0]):
                    yield held[0] if len(held) == 1 else pd.concat(held)
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield held[0] if len(held) == 1 else pd.concat(held)

    def emitted(pdf: pd.DataFrame, hmm: Hmm) -> tuple[np.ndarray, np.ndarray]:
        scores = [hmm.score(t, int(p)) for t, p in zip(pdf["text"], pdf["place"], strict=True)]
        opens = np.concatenate([np.arange(len(s)) == 0 for s in scores])
        return np.concatenate(scores), opens

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of blocks of conversations with several: best score from each state before to each last state."""
        hmm = shared.value
        for pdf in blocks(batches):
            scores, opens = emitted(pdf, hmm)
            n = len(ROLES)
            table = np.stack([viterbi(scores, opens, hmm, np.where(np.arange(n) == k, 0.0, -np.inf))[0] for k in range(n)])
            yield pa.RecordBatch.from_arrays([pa.array([int(pdf["conv_id"].iloc[0])], pa.int64()), pa.array([int(pdf["part"].iloc[0])], pa.int64()), pa.array([table.ravel().tolist()], pa.list_(pa.float64()))], ["conv_id", "part", "table"])

    def joined(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """Along a conversation's blocks: the state before each block and its last one."""
        hmm, n = shared.value, len(ROLES)
        pdf = pdf.sort_values("part")
        tables = [np.array(t).reshape(n, n) for t in pdf["table"]]
        best, back = None, []
        for k, table in enumerate(tables):
            step = (hmm.start if not k else best)[:, None] + table
            back.append(step.argmax(axis=0))
            best = step.max(axis=0)
        last = [int(best.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last.reverse()
        return pd.DataFrame({"conv_id": key[0], "part": pdf["part"].to_numpy(), "from": last[:-1], "last": last[1:]})

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, n = shared.value, len(ROLES)
        for pdf in blocks(batches):
            scores, opens = emitted(pdf, hmm)
            given = pdf["from"].iloc[0]
            if pd.isna(given):
                best, back = viterbi(scores[1:], opens[1:], hmm, hmm.start + scores[0])
                states = trace(back, int(best.argmax()))
            else:
                _, back = viterbi(scores, opens, hmm, np.where(np.arange(n) == int(given), 0.0, -np.inf))
                states = trace(back, int(pdf["last"].iloc[0]))[1:]
            rows, at = [], 0
            for conv, turn, role, text, copies, place in zip(pdf["conv_id"], pdf["turn"], pdf["role"], pdf["text"], pdf["n_rows"], pdf["place"], strict=True):
                lines = lines_of(text)
                own = states[at : at + len(lines)]
                at += len(lines)
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(lines)]
                turns = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    body = "\n".join(x[marker(x)[1] :].rstrip() for x in lines[a:b]).strip()
                    turns.append(f"<|{ROLES[own[a]]}|>\n{body}\n<|end|>\n")
                whole = lambda x: None if pd.isna(x) else int(x)
                rows.append((whole(conv), whole(turn), role, int(place), ROLES[own[0]], int(copies), len(lines), len(cuts) - 2, "".join(turns)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in OUT.split(", ")])

    several = common.cut(rows.filter("part > 0").select("conv_id").distinct(), "several")
    if several.limit(1).count():
        tables = keyed.join(several, "conv_id", "left_semi").repartition("key").sortWithinPartitions("key", "conv_id", "part", "place").mapInArrow(sums, "conv_id long, part long, table array<double>")
        ends = common.cut(tables.groupBy("conv_id").applyInPandas(joined, "conv_id long, part long, `from` int, last int"), "ends")
        keyed = keyed.join(ends, ["conv_id", "part"], "left").repartition("key").sortWithinPartitions("key", "conv_id", "part", "place")
    else:
        keyed = keyed.withColumns({"from": F.lit(None).cast("int"), "last": F.lit(None).cast("int")})
    return keyed.mapInArrow(render, OUT)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(common.table(spark, sf_dir, "conversations"))
