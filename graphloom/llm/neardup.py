"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of five-word shingles, banded, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Words of a shingle and least weighted Jaccard similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: A pair at the threshold shares none of BANDS bands of ROWS values with probability 7e-5; at 0.85, 1e-6.
BANDS, ROWS = 24, 5
SIGNATURE = BANDS * ROWS
_ORDER = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: common.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each shingle; a row of fewer words, but not none, is one shingle."""
    n = len(w.key)
    total, ends = np.zeros(n, np.uint64), np.repeat(w.first[1:], w.counts)
    at = np.arange(n)
    for j in range(size):
        shifted = np.zeros(n, np.uint64)
        shifted[: max(0, n - j)] = w.key[j:] * _ORDER[j]
        total += np.where(at + j < ends, shifted, np.uint64(0))
    begin = np.repeat(w.first[:-1], w.counts)
    whole = (at + size <= ends) | (at == begin)
    return w.rows()[whole], common.mix64(total[whole])


def weighted(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) in order, and how often each occurs."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return row[first], key[first], np.diff(np.append(first, len(row)))


def bag_minhash(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, m: int = SIGNATURE) -> np.ndarray:
    """Signatures (rows x m, as bits of times); two agree in a place with the probability of their weighted Jaccard.

    The weight axis is cut into [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each interval of an element has a Poisson
    process of the interval's length as rate, whose points carry a signature place and a level within the
    interval; a point counts if its level is below the weight. A place's value is its least time. The points of
    a row are drawn in order of time, as far as its places are not all filled: some m log m, whatever the weights.
    """
    top = int(weight.max()) if len(weight) else 1
    part = [(np.flatnonzero(weight > (0 if not j else 1 << (j - 1))), j) for j in range(top.bit_length() + 1)]
    src = np.concatenate([p for p, _ in part]).astype(np.int64)
    level = np.concatenate([np.full(len(p), j) for p, j in part]).astype(np.uint64)
    low = np.where(level > 0, np.left_shift(np.uint64(1), np.maximum(level, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    width = np.maximum(low, np.uint64(1))
    rate = width.astype(np.float64)
    seed = common.mix64(key[src] + (level + np.uint64(1)) * _STEP)
    owner, above = row[src], (weight[src] - low.astype(np.int64)).astype(np.uint64)
    total = np.bincount(row, weight, rows)
    until = m * (np.log(m) + 2) / np.maximum(total, 1)
    times = np.full(rows * m, np.inf)

    def draw(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = common.mix64(seed[k] + n * _STEP)
        return r, -np.log(((r >> np.uint64(12)).astype(np.float64) + 1) / (1 << 52)) / rate[k]

    every = np.arange(len(src))
    count = np.ones(len(src), np.uint64)
    bits, next_ = draw(every, count)
    while len(every):
        live = every[next_[every] < until[owner[every]]]
        while len(live):
            r = bits[live]
            place = ((r & np.uint64(0xFFF)) * np.uint64(m)) >> np.uint64(12)
            place = (place + (common.mix64(r) >> np.uint64(32)) % np.uint64(m)) % np.uint64(m)
            good = common.mix64(r ^ _STEP) % width[live] < above[live]
            np.minimum.at(times, (owner[live] * m + place.astype(np.int64))[good], next_[live][good])
            count[live] += np.uint64(1)
            bits[live], gap = draw(live, count[live])
            next_[live] += gap
            live = live[next_[live] < until[owner[live]]]
        short = np.isinf(times.reshape(rows, m)).any(axis=1) & (total > 0)
        until[short] *= 2
        every = every[short[owner[every]]]
    return times.view(np.uint64).reshape(rows, m)


def _bands(signature: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        out = common.mix64(out * _ORDER[0] + signature[:, r::ROWS][:, :BANDS])
    return common.mix64(out + np.arange(BANDS, dtype=np.uint64) * _ORDER[1])


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, fp1 and fp2 (128 bits of the sequence of words, null without words), bands array<long>."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in common.chunks(texts):
                w = common.Words(texts.slice(a, b - a))
                n = b - a
                row, key, weight = weighted(*shingles(w))
                bands = _bands(bag_minhash(row, key, weight, n)).view(np.int64)
                local = (np.arange(len(w.key)) - np.repeat(w.first[:-1], w.counts)).astype(np.uint64)
                empty = w.counts == 0
                sums = np.concatenate([[np.uint64(0)], np.cumsum(common.mix64(w.key ^ (local * _ORDER[2])))]), np.concatenate([[np.uint64(0)], np.cumsum(common.mix64(w.key + local * _ORDER[3]))])
                prints = [pa.array((s[w.first[1:]] - s[w.first[:-1]]).view(np.int64), mask=empty) for s in sums]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), *prints, lists], ["doc_id", "fp1", "fp2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(run), "doc_id long, fp1 long, fp2 long, bands array<long>")


def elements(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted 32-bit hashes of its (shingle, occurrence) pairs: multiset overlap becomes set overlap.

    Two of n by chance share a hash with n / 2^32: that moves a similarity by less than 1e-5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in common.chunks(texts):
                row, key, weight = weighted(*shingles(common.Words(texts.slice(a, b - a))))
                again = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                row = np.repeat(row, weight)
                key = (common.mix64(np.repeat(key, weight) + again.astype(np.uint64) * _STEP) >> np.uint64(32)).astype("<u4")
                order = np.lexsort((key, row))
                key, first = key[order], np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([key[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["doc_id", "elements"])

    return docs.mapInArrow(common.tidy(run), "doc_id long, elements binary")


def similarity(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(x) + len(y) - shared)


def verify(pairs: DataFrame, elems: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of pairs (u, v) those whose multisets of shingles overlap enough."""
    left = elems.select(F.col("doc_id").alias("u"), F.col("elements").alias("a"))
    right = elems.select(F.col("doc_id").alias("v"), F.col("elements").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(x.as_py(), y.as_py()) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(common.tidy(run), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """id and comp, the least id that links (u, v) reach from it: hook to the least neighbour, jump, contract."""
    edges, names = links.select("u", "v"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = common.cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "parent")
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = common.cut(parent.join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "jump")
            parent = jumped.select("u", "p")
            if not jumped.filter("moved").limit(1).count():
                break
        if names is None:
            names = parent.select(F.col("u").alias("id"), F.col("p").alias("comp"))
        else:
            names = names.join(parent.select(F.col("u").alias("comp"), "p"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp"))
        names = common.cut(names, "names")
        a, b = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = common.cut(edges.join(a, "u").join(b, "v").filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        if not edges.limit(1).count():
            return names


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id (least doc_id of its class), n_same (documents with its words).

    Texts with equal sequences of words are one class; two such texts are linked if the weighted Jaccard similarity
    of their five-word shingles is 0.8 or more; classes are what links connect. Null texts and texts
    without words are classes of their own; a null doc_id has a null class. Repeated rows of one id and text are rows
    of one class; where an id stands on different texts, each of them is a document of its own.
    """
    signed = common.cut(sign(docs), "signed")
    if not docs_mixed(docs, signed):
        return _near_duplicates(docs, signed)
    return _by_text(docs).select("doc_id", "class_id", "n_same")


def docs_mixed(docs: DataFrame, signed: DataFrame) -> bool:
    """Whether any doc_id stands on different texts."""
    if not docs_repeat(signed):
        return False
    texts = docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(_text_key()) != F.max(_text_key())).alias("mixed"))
    return not texts.filter("mixed").isEmpty()


def _text_key():
    """A 64-bit hash of a row's id and text, null where the id is."""
    text = F.col("text").cast("string")
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(text, F.lit("")), text.isNull()))


def _by_text(docs: DataFrame) -> DataFrame:
    """Classes of the distinct (doc_id, text), as for ids on different texts: a row for each of docs' rows with key, doc_id,
    head (key of the class's first by doc_id), class_id, n_same."""
    rows = docs.select(_text_key().alias("doc_id"), "text")
    found = _near_duplicates(rows, common.cut(sign(rows), "signed")).select(F.col("doc_id").alias("key"), F.col("class_id").alias("comp"), "n_same")
    found = common.cut(found, "by_text")
    ids = common.cut(docs.select(_text_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id")).groupBy("key", "doc_id").agg(F.count("*").alias("n_key")), "ids")
    known = common.join_hot(found.filter("key is not null"), ids.filter("key is not null"), ["key"], "n_key")
    known = common.cut(known.select("key", "doc_id", "comp", "n_same"), "known")
    first = F.min(F.struct("doc_id", "key"))
    heads = known.groupBy("comp").agg(first.alias("m"), F.count("*").alias("n_comp")).select("comp", "n_comp", F.col("m.key").alias("head"), F.col("m.doc_id").alias("class_id"))
    named = common.join_hot(known, common.cut(heads, "heads"), ["comp"], "n_comp").select("key", "doc_id", "head", "class_id", "n_same")
    none = F.lit(None).cast("long")
    return named.unionByName(found.filter("key is null").select("key", none.alias("doc_id"), none.alias("head"), none.alias("class_id"), "n_same"))


def _near_duplicates(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """near_duplicates where no doc_id stands on different texts.

    Each band's bucket is compared with its least member, one pair a member. Where that leaves a bucket in several
    components, buckets of up to SMALL members compare all of them, larger ones another leader, then each member its
    likeliest partners of other components, and at last all pairs between components whose sketches allow for the
    threshold, which a pair at it misses with probability 2e-9. Sketches are held against each other in blocks of
    BLOCK members, so no task takes a whole bucket.
    """
    some = signed.filter("fp1 is not null and doc_id is not null")
    same = common.cut(some.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_same")), "same")
    reps = some.join(same.select(F.col("rep").alias("doc_id"), "fp1", "fp2"), ["doc_id", "fp1", "fp2"]).dropDuplicates(["doc_id", "fp1", "fp2"])
    banded = common.cut(reps.select("doc_id", F.explode("bands").alias("band")), "banded")
    buckets = common.cut(banded.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = common.cut(common.join_hot(banded, buckets, ["band"], "n"), "members")
    pairs = common.cut(members.filter("doc_id <> leader").select(F.col("doc_id").alias("u"), F.col("leader").alias("v")).distinct(), "pairs")
    ids = common.cut(pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "doc_id"), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    elems = common.cut(elements(common.with_ids(texts, ids, "left_semi")).dropDuplicates(["doc_id"]) if docs_repeat(signed) else elements(common.with_ids(texts, ids, "left_semi")), "elements", "none")
    links = common.cut(verify(pairs, elems), "links")
    named = components(links) if links.limit(1).count() else None  # then contracted as links come
    sketches = common.cut(sketched(elems), "sketches")
    for number in range(LAST + 1):
        rest = _rest(members, named, number, sketches)
        if rest is None:
            break
        rest = common.cut(rest.join(pairs, ["u", "v"], "left_anti"), "rest")
        pairs = pairs.unionByName(rest)
        more = common.cut(verify(rest, elems), "more")
        if more.limit(1).count():
            named = _renamed(named, more)
    classes = same.withColumnRenamed("rep", "id")
    if named is not None:
        classes = classes.join(named, "id", "left")
    else:
        classes = classes.withColumn("comp", F.lit(None).cast("long"))
    classes = common.cut(classes.select("fp1", "fp2", "n_same", F.coalesce("comp", "id").alias("class_id")), "classes")
    found = common.join_hot(some.select("doc_id", "fp1", "fp2"), classes, ["fp1", "fp2"], "n_same").select("doc_id", "class_id", "n_same")
    alone = signed.filter("fp1 is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_same"))
    return found.unionByName(alone)


def docs_repeat(signed: DataFrame) -> bool:
    """Whether any doc_id stands in more than one row."""
    return bool(signed.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").limit(1).count())


#: Members of a bucket up to which all its components are compared at once; members of a block; and bins of a sketch,
#: of which the first FEW are looked at first. Rounds 1 to LAST - 1 take each member's likeliest partners, round LAST
#: all that are left.
SMALL, BLOCK, BINS, FEW, LAST = 8, 2048, 1024, 128, 2
#: Standard deviations by which a sketch may fall short of the threshold: a chance of 1e-9 a look.
MARGIN = 6.0


def sketched(elems: DataFrame) -> DataFrame:
    """doc_id, size (how many elements) and sketch: the elements fall into BINS bins, a byte each for the least of a bin's, 0 for an empty bin.

    The share of equal bytes among bins not empty in both estimates the similarity of two documents. The least ones of
    the bins are a sample without replacement of the union: the more bins it fills, the surer.
    """
    shift = np.uint32(32 - BINS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], []
            for x in batch.column(1):
                key, sketch = np.frombuffer(x.as_py(), "<u4"), np.zeros(BINS, np.uint8)
                bins, first = np.unique(key >> shift, return_index=True)
                sketch[bins] = 1 + common.mix64(key[first].astype(np.uint64)) % np.uint64(255)
                out.append(sketch.tobytes())
                size.append(len(key))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "size", "sketch"])

    return elems.mapInArrow(common.tidy(run), "doc_id long, size long, sketch binary")


def _allowed(same: np.ndarray, bins: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None, least: float = SIMILARITY) -> np.ndarray:
    """Whether so many equal bins are not too few for two documents at the threshold; their sizes bound the union."""
    spread = least * (1 - least) * bins
    if left is not None:
        spread = spread * np.maximum(0, 1 - bins * (1 + least) / np.maximum(left + right, 1))
    return same >= least * bins - MARGIN * np.sqrt(spread) - 1


def alike(left: np.ndarray, right: np.ndarray, differ: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated similarity of each row of left to each of right; 0 where `differ` is false or it is surely too low."""
    few, same = slice(0, FEW), np.zeros(differ.shape, np.float32)
    for a, b in zip(left[:, few].T, right[:, few].T, strict=True):
        same += a[:, None] == b[None]
    empty = (left[:, few] == 0).astype(np.float32) @ (right[:, few] == 0).astype(np.float32).T
    near = SIMILARITY * np.maximum(sizes[0][:, None], sizes[1][None]) <= np.minimum(sizes[0][:, None], sizes[1][None]) + 1e-6
    a, b = np.nonzero(differ & near & _allowed(same - empty, FEW - empty))
    out = np.zeros(differ.shape, np.float32)
    for k in range(0, len(a), 4096):
        i, j = a[k : k + 4096], b[k : k + 4096]
        x, y = left[i], right[j]
        bins = ((x | y) != 0).sum(axis=1)
        equal = ((x == y) & (x != 0)).sum(axis=1)
        out[i, j] = np.where(_allowed(equal, bins, sizes[0][i], sizes[1][j]), np.maximum(equal, 1e-3) / np.maximum(bins, 1), 0)
    return out


def _blocks(within: DataFrame, sketches: DataFrame, best: bool) -> DataFrame:
    """Pairs (u, v) of different components of a bucket whose sketches allow for a link; or only each member's best ones.

    Members are dealt to blocks by hash; each two blocks, and each block with itself, are one group of up to about
    two blocks.
    """

    def run(group: pa.Table) -> pa.Table:
        ids, comp, side, size = (group.column(c).to_numpy() for c in ("doc_id", "comp", "own", "size"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), BINS)
        x, y = (np.flatnonzero(side == group.column(c)[0].as_py()) for c in ("i", "j"))
        est = alike(sketch[x], sketch[y], comp[x][:, None] != comp[y][None], (size[x], size[y]))
        if best and est.size:
            a = np.concatenate([np.arange(len(x)), est.argmax(axis=0)])
            b = np.concatenate([est.argmax(axis=1), np.arange(len(y))])
            some = est[a, b] > 0
            a, b = a[some], b[some]
        else:
            a, b = np.nonzero(est)
        u, v = ids[x[a]], ids[y[b]]
        pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
        return pa.table({"u": pa.array(pairs[0], pa.int64()), "v": pa.array(pairs[1], pa.int64())})

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = within.select("band", "doc_id", "comp", blocks.alias("blocks"), F.pmod(F.xxhash64("doc_id", F.lit("block")), blocks).cast("int").alias("own"))
    rows = rows.join(sketches, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "comp", "size", "sketch")
    return rows.groupBy("band", "i", "j").applyInArrow(run, "u long, v long")


def _comps(rows: DataFrame, named: DataFrame | None, key: str, comp: str) -> DataFrame:
    """rows with the component of the document in column key."""
    if named is None:
        return rows.withColumn(comp, F.col(key))
    return rows.join(named.select(F.col("id").alias(key), F.col("comp").alias(comp)), key, "left").withColumn(comp, F.coalesce(comp, key))


def _renamed(named: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after new links: those that the links join are contracted."""
    joined = _comps(_comps(links, named, "u", "cu"), named, "v", "cv").filter("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
    joined = common.cut(joined, "joined")
    if not joined.limit(1).count():
        return named
    merged = components(joined)
    if named is None:
        return merged
    old = named.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    alone = merged.join(named.select("id"), "id", "left_anti")
    return common.cut(old.unionByName(alone.select("id", "comp")), "renamed")


def _rest(members: DataFrame, named: DataFrame | None, number: int, sketches: DataFrame) -> DataFrame | None:
    """Pairs (u, v) to compare where a bucket's members are still in different components; None if nowhere.

    First, small buckets' components against each other, and of larger ones each member against a leader; then
    pairs whose sketches are alike, at last all of them.
    """
    comps = common.cut(_comps(members.select("band", "doc_id"), named, "doc_id", "comp"), "comps")
    order = F.struct(F.xxhash64("doc_id", F.lit(number)).alias("h"), F.col("doc_id").alias("leader"), F.col("comp").alias("head_comp"))
    split = comps.groupBy("band").agg((F.min("comp") != F.max("comp")).alias("split"), F.count("*").alias("n"), F.min(order).alias("m")).filter("split")
    split = common.cut(split.select("band", "n", "m.leader", "m.head_comp"), "split")
    large = split.filter(F.col("n") > SMALL)
    if not (split if not number else large).limit(1).count():
        return None
    within = common.cut(common.join_hot(comps, split, ["band"], "n"), "within")
    if not number:
        found = within.filter("n > 2 and comp <> head_comp").select(F.col("doc_id").alias("u"), F.col("leader").alias("v"))
        few = within.filter(F.col("n") <= SMALL).select("band", "doc_id", "comp")
        all_ = few.alias("a").join(few.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.comp") != F.col("b.comp")))
        found = found.unionByName(all_.select(F.col("b.doc_id").alias("u"), F.col("a.doc_id").alias("v")))
    else:
        found = _blocks(within.filter(F.col("n") > SMALL), sketches, number < LAST)
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the least id stays, and of rows with its id and text one. Rows without
    id stay: nothing says which of them is first."""
    signed = common.cut(sign(docs), "signed")
    if docs_mixed(docs, signed):
        drop = _by_text(docs).filter("key <> head").select(F.col("key").alias("_key")).distinct()
        key = common.fresh(docs, "key")
        kept = common.with_ids(docs.withColumn(key, _text_key()), common.cut(drop.withColumnRenamed("_key", key), "drop"), "left_anti", key)
        return kept.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.filter(F.col(key).isNull())).select(*docs.columns)
    found = common.cut(_near_duplicates(docs, signed), "classes")
    drop = found.filter("doc_id <> class_id").select("doc_id").distinct()
    kept = common.with_ids(docs, common.cut(drop, "drop"), "left_anti").select(*docs.columns)
    if not docs_repeat(found):
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
