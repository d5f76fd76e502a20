"""Each training-data operator on small tables: odd inputs, and brute force or an exact round trip."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, common, decontaminate, gif, langid, licenses, neardup, packing, toxicity, urls, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null and empty texts, no words, ties, repeated rows, a long text, extra columns with clashing names."""
    long_ = " ".join(f"w{k * k % 997}" for k in range(60_000))
    rows = [(1, "one two three four five six seven"), (2, "One two, three four five six seven!"), (3, None), (4, ""), (5, "!!! ???"), (6, long_), (6, long_), (None, "nobody's text is here today"), (8, "été à Übung ñandú 日本語 😀"), (9, "a"), (9, "b")]
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, label string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_words_match_the_pattern():
    texts = ["Ab c1-d É_x", "", "...", "a", "x\x00y", "日本 語", "Z" * 50]
    w = common.Words(pa.array([None, *texts]))
    assert w.counts.tolist() == [0, *(len(words(t)) for t in texts)]
    low = [bytes(common.LOWER[w.data[a:b]]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert low == [x for t in texts for x in words(t)]
    assert common.word_keys("same Same").tolist()[0] == common.word_keys("SAME")[0]


def test_join_hot_keeps_all_rows(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 700).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    assert common.join_hot(left, right, ["k"], "n", parts=4).count() == 3000


def test_langid(spark, odd, empty):
    docs = spark.createDataFrame([(k, ("the thing that was " if k % 2 else "der die das und nicht ") * 5, "en" if k % 2 else "de") for k in range(80)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert langid.identify(docs, model).filter("lang <> lang_pred").count() == 0
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[1] == "en"
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert langid.fit(empty) is None


def test_toxicity_learns(spark, odd, empty):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["tree", "river", "stone", "cloud", "wind", "leaf"]) for _ in range(60)) for _ in range(300)]
    texts = [t.replace("stone", "scoundrel", 2) if k % 4 == 0 else t for k, t in enumerate(texts)]
    net = toxicity.train(pa.array(texts[:240]), np.array([k % 4 == 0 for k in range(240)], int), epochs=6)
    got = net.score(pa.array(texts[240:])) >= 0.5
    assert (got == np.array([k % 4 == 0 for k in range(240, 300)])).mean() > 0.9
    assert toxicity.assess(odd, net).filter("tox_score between 0 and 1").count() == odd.count()
    assert toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.assess(empty, None).count() == 0


def test_toxicity_gradients():
    net = toxicity.Net(np.sort(common.word_keys("a b c")), seed=3)
    col = pa.array(["a b xyz c a", "c c b"])
    w = common.Words(col)
    ids, grams, first, inverse = net.inputs(w)
    places, real, _ = toxicity.windows(w.first)
    which, y, weight = inverse[places], np.array([1.0, 0.0], np.float32), np.ones(2, np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)

    def loss():
        z = net.run(net.vectors(ids, grams, first), which, real)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = net.step(net.vectors(ids, grams, first), ids, grams, first, which, real, y, weight)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        v[at] += 1e-4
        up = loss()
        v[at] -= 2e-4
        slope = (up - loss()) / 2e-4
        v[at] += 1e-4
        assert abs(slope - g[k][at]) < 0.02 * abs(slope) + 2e-4, k


def brute_classes(rows):
    bags = {}
    for i, t in rows:
        w = words(t)
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    home = {i: i for i in bags}
    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                m = sum((bags[a] & bags[b]).values())
                if m / (sum(bags[a].values()) + sum(bags[b].values()) - m) >= 0.8 and home[a] != home[b]:
                    low, high = sorted((home[a], home[b]))
                    home = {k: low if v == high else v for k, v in home.items()}
    return home


def test_neardup_is_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"t{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 9])):
                copy[rng.randrange(120)] = f"n{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(copy)))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_neardup_odd(odd, empty):
    got = collections.defaultdict(set)
    rows = neardup.near_duplicates(odd).collect()
    for r in rows:
        got[r["doc_id"]].add(r["class_id"])
    assert len(rows) == odd.count()
    assert got[2] == got[1] == {1} and got[3] == {3} and got[4] == {4} and got[5] == {5} and got[6] == {6} and got[None] == {None}
    assert neardup.near_duplicates(empty).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    errors = []
    for t in range(30):
        a = {k + 999 * t: int(rng.integers(1, 9)) for k in range(150)}
        b = {k: (int(rng.integers(1, 20)) if rng.random() < 0.3 else v) for k, v in a.items()}
        true = sum(min(a[k], b[k]) for k in a) / sum(max(a[k], b[k]) for k in a)
        sign = [neardup.bag_minhash(np.zeros(len(x), int), common.mix64(np.array(list(x), np.uint64)), np.array(list(x.values())), 1)[0] for x in (a, b)]
        errors.append((sign[0] == sign[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.03


def test_decontaminate_is_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 8, 12])))) for k in range(30)] + [(99, None), (98, "...")]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 200))) + " " + rng.choice(items[:30])[1].upper()) for k in range(40)] + [(100, None), (101, "")]
    got = {r["doc_id"]: r for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for k, item in items:
            x = words(item)
            n = min(8, len(x))
            for win in {tuple(x[a : a + n]) for a in range(len(x) - n + 1)} if n else ():
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) == win:
                        hit |= set(range(s, s + n))
                        found.add(str(k))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found))


def test_decontaminate_blocks_and_odd(spark, odd, empty, monkeypatch):
    bench = spark.createDataFrame([(k, f"one two three four five six seven eight n{k}") for k in range(9)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    got = decontaminate.find(odd.union(spark.createDataFrame([(50, "x one two three four five six seven eight", "", "", 0, 0.0, "")], odd.schema)), bench).filter("n_items > 0").collect()
    assert [(r["doc_id"], r["n_items"], r["n_hit"]) for r in got] == [(50, 9, 8)]
    assert decontaminate.find(empty, bench).count() == 0
    assert decontaminate.find(odd, bench.limit(0)).filter("n_items > 0").count() == 0


def test_packing_round_trip(odd, empty):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["It's I'LL don't", "<|endoftext|> a<|startoftext|>", "ÀÉ×÷ª½ x²3", "日本語 İ Σς", "a b\u0085c\x1fd", "12ab--cd''s", "", None]
    ids, first = packing.encoder(packing.tokenizer_path()).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == known.encode(t or "", add_special_tokens=False).ids + [0]
    rows = packing.pack(common.cut(packing.pieces(odd), "p")).toPandas()
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all() and g["length"].sum() <= 2048
    whole = np.array(known.encode(odd.filter("doc_id = 6").first()["text"], add_special_tokens=False).ids + [0], "<u4")
    mine = rows[rows["doc_id"] == 6].drop_duplicates("piece").sort_values("piece")
    assert [zlib.crc32(whole[a : a + n].tobytes()) for a, n in zip(mine["start"], mine["length"], strict=True)] == mine["ids_crc32"].tolist()
    assert packing.pack(common.cut(packing.pieces(empty), "p")).count() == 0


def test_lower_bound_holds():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(1, 2049, rng.integers(1, 60))
        bins, offsets, fill = packing.best_fit(x)
        assert packing.lower_bound(x) <= len(fill) and fill.max() <= 2048 and fill.sum() == x.sum()
    assert packing.lower_bound(np.array([1025] * 10)) == 10


@pytest.mark.parametrize("values", [1, 2, 3, 256])
def test_gif_round_trip(values):
    rng = np.random.default_rng(values)
    for n in (64, 640, 64 * 700):
        data = rng.integers(0, values, n).astype(np.uint8).tobytes()
        assert b"".join(f["indices"].tobytes() for f in gif.read(gif.write(data))["frames"]) == data


def test_gif_disposal_and_transparency():
    def frame(disposal, index, see):
        pixels = bytes([index] * 4)
        return b"\x21\xf9\x04" + bytes([disposal << 2 | (see is not None), 5, 0, see or 0]) + b"\0\x2c" + bytes(4) + b"\2\0\2\0\0" + b"\x08" + gif._blocks(gif.lzw_encode(pixels))

    file = b"GIF89a\2\0\2\0\xf7\0\0" + gif.GREYS + frame(1, 10, None) + frame(3, 20, None) + frame(2, 30, 30) + frame(1, 40, 40) + b"\x3b"
    seen = [(a, d, int(c[0, 0, 0]), int(c[0, 0, 3])) for a, d, c in gif.compose(gif.read(file))]
    assert seen == [(0, 5, 10, 255), (5, 5, 20, 255), (10, 5, 10, 255), (15, 5, 0, 0)]
    assert sum(gif.frame_rows(file)[0]["histogram"]) == 4


def test_gif_query_columns(odd, empty):
    rows = gif.digest(gif.store(odd)).collect()
    texts = {(r["doc_id"], len((r["text"] or "").encode())): (r["text"] or "").encode() for r in odd.collect()}
    for r in rows:
        b = texts[r["doc_id"], r["n_bytes"]]
        b = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        if r["doc_id"] != 9:
            assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(b).hexdigest(), zlib.crc32(b[-64:]))
    assert len(rows) == odd.count() and gif.digest(gif.store(empty)).count() == 0


def test_toxic_windows_overlap_by_half():
    for n in (1, 32, 33, 200, 331):
        places, real, firsts = toxicity.windows(np.array([0, n]))
        seen = [set(p[r].tolist()) for p, r in zip(places, real)]
        size = min(n, toxicity.WINDOW // 2 + 1)
        assert len(seen) == firsts[-1] and set().union(*seen) == set(range(n))
        assert all(any(set(range(a, a + size)) <= x for x in seen) for a in range(n - size + 1))


def test_licenses(spark, odd, empty):
    scanner = licenses.Scanner()
    mit = licenses.TEMPLATES["mit"][0]
    a, b, c = scanner.scan(pa.array(["x " + mit.upper() + " y", "under the MIT license under the mit license", "cc by" ]))
    assert [x[0] for x in a["chains"]] == ["mit"] and a["chains"][0][1] == 1
    assert [p for p, _ in sorted(b["base"])] == [0, 4] and not c["base"] and not c["chains"]
    assert scanner.scan(pa.array(["cc by", "nc"]))[0]["base"] == []
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count() and all(r["base_labels"] == "" and 0 <= r["score"] <= 1 for r in rows)
    assert licenses.scan(empty).count() == 0


def test_matching_statistics():
    rng = random.Random(2)
    texts = [np.array([rng.randrange(4) for _ in range(30)], np.uint64) for _ in range(3)]
    auto = licenses.Automaton(texts)
    subs = {tuple(t[a:b].tolist()) for t in texts for a in range(30) for b in range(a, 31)}
    probe = [rng.randrange(5) for _ in range(200)]
    for k, (_, n) in enumerate(auto.stream(probe)):
        assert n == max(m for m in range(k + 2) if tuple(probe[k + 1 - m : k + 1]) in subs)


def test_license_phrases_are_whole(spark):
    rng = random.Random(9)
    pieces = [x.split() for x in licenses.PHRASES] + [["license", "version", "2"], ["gnu", "general", "public"], ["version", "2"], ["the", "mit", "license"], ["cc", "by"], ["nc"], ["apache"], ["under"], ["other"]]
    texts = ["license version 2", "gpl license version 2", "GNU General Public License version 2", "apache license version 2", "under apache license version 2", "the mit license"]
    texts += [" ".join(w for _ in range(12) for w in rng.choice(pieces)) for _ in range(300)]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        w = words(texts[r["doc_id"]])
        want = [(k, label) for x, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(x.split())] == x.split()]
        places = [k for k, _ in want]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(want), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in want}))


def test_warc(spark):
    big = "<p>" + "é" * 800
    rows = [(1, "http://a/", big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "x", None), (None, "n", big), (7, "http://b/\nc", "x\r\n\r\ny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    raw, members = warc.archive(pages)
    got = {r["page_id"]: r for r in warc.read_records(members).collect()}
    assert len(got) == len(rows)
    assert (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 2) and got[2]["record_type"] == "response"
    for i, _, html in rows:
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len((html or "").encode()), hashlib.sha1((html or "").encode()).hexdigest())
    assert got[3]["record_type"] == got[4]["record_type"] == "response"
    parts = [x for r in raw.collect() for x in warc.records(bytes(r["archive"]), step=7)]
    assert len(parts) == len(rows)
    assert warc.read_records(warc.archive(pages.limit(0))[1]).count() == 0


def test_warc_without_broadcast(spark, monkeypatch):
    big = ["<p>" + x * 1200 for x in "abcdef"]
    rows = [(1, big[0]), (1, "short"), (1, big[1]), (1, big[2]), (2, big[0]), (3, big[1]), (3, big[3]), (None, big[0]), (None, None), (4, "short"), (5, big[4]), (5, big[4]), (6, None)]
    rows += [(10 + k, big[5]) for k in range(40)]
    pages = spark.createDataFrame([(i, f"u{k}", h) for k, (i, h) in enumerate(rows)], "page_id long, url string, html string")
    last = {h: max(j for j, x in rows if x == h and j is not None) for _, h in rows if h and len(h) >= 1000}
    want = sorted((f"u{k}", i, h or "", last[h] if h in last and i is not None and last[h] != i else None) for k, (i, h) in enumerate(rows))
    for limit in (300_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", limit)
        got = sorted((r["url"], r["page_id"], r["html"], r["refers_to"]) for r in warc.decide(pages).collect())
        assert [x[:2] for x in got] == [x[:2] for x in want], limit
        assert got == want, limit


def test_urls(spark):
    rows = [(1, "http://A.example.com/en/1?x"), (2, "https://www.example.com/en/2"), (3, "x.net/es/1"), (4, "http://x.net/es/1#f"), (5, None), (6, "http://b.org"), (6, "http://b.org"), (8, "ftp://q.NET?/es/"), (9, "http://notexample.com/en/"), (10, "http://net/fr/")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    pick = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"])
    assert pick(1) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert pick(2) == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert pick(3)[:3] == ("", "", None) and pick(5)[:3] == ("", "", None)
    assert pick(4) == ("x.net", "/es/1", "net/es/", "block") and pick(8)[:3] == ("q.net", "", None)
    assert pick(9) == ("notexample.com", "/en/", "com/", "allow") and pick(10)[3] == "block"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_chat(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], ("why is that?" if t % 2 == 0 else "because it is so\nand this is how it goes on and on")) for c in range(40) for t in range(4)]
    rows += [(50, 0, None, "Human: hello\nAssistant: hi there"), (None, None, "user", None), (51, 0, "odd", ""), (51, 0, "odd", "")]
    rows += [(60, t, ("user", "assistant")[t % 2], "q?" if t % 2 == 0 else "it is so and so\nthat it goes on") for t in range(1100)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r["n_rows"] for r in got) == len(rows)
    known = [r for r in got if r["conv_id"] is not None and (r["conv_id"] < 40 or r["conv_id"] == 60)]
    assert sum(r["role"] == r["role_pred"] for r in known) > 0.97 * len(known)
    marked = next(r for r in got if r["conv_id"] == 50)
    assert marked["rendered"] == "<|user|>\nhello\n<|end|>\n<|assistant|>\nhi there\n<|end|>\n"
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_sketches_keep_links():
    rng = np.random.default_rng(4)
    for size in (1, 9, 60, 700, 5000):
        base = rng.integers(0, 1 << 32, size, dtype=np.uint32)
        many = []
        for k in range(30):
            x = base.copy()
            some = rng.random(size) < k / 100
            x[some] = rng.integers(0, 1 << 32, int(some.sum()), dtype=np.uint32)
            many.append(np.unique(x).astype("<u4"))
        rows = list(neardup.sketched(_Batches([x.tobytes() for x in many])))
        sketch = np.stack([np.frombuffer(x, np.uint8) for x in rows[0].column(2).to_pylist()])
        n = rows[0].column(1).to_numpy()
        est = neardup.alike(sketch, sketch, ~np.eye(30, dtype=bool), (n, n))
        for i in range(30):
            for j in range(30):
                if i != j and neardup.similarity(many[i].tobytes(), many[j].tobytes()) >= neardup.SIMILARITY:
                    assert est[i, j] > 0
        assert not np.diag(est).any()


class _Batches:
    """Stands for a DataFrame of elements: runs what mapInArrow is given."""

    def __init__(self, elements):
        self.batch = pa.RecordBatch.from_arrays([pa.array(range(len(elements))), pa.array(elements, pa.binary())], ["doc_id", "elements"])

    def mapInArrow(self, run, schema):
        return run(iter([self.batch]))


def test_neardup_large_bucket_of_many_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(8)
    passage, rows = [f"p{k}" for k in range(90)], []
    for _ in range(25):
        own = [f"q{rng.randrange(99999)}" for _ in range(32)]
        for _ in range(2):
            copy = passage + own
            copy[rng.randrange(95, 122)] = f"n{rng.randrange(99999)}"
            rows.append((len(rows), " ".join(copy)))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_neardup_ids_on_different_texts(spark, tmp_path):
    rng = random.Random(3)
    a, b, c = (" ".join(f"{x}{rng.randrange(9999)}" for _ in range(120)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (7, a + " end"), (8, b + " end"), (9, c), (9, c + " end"), (2, c), (4, None), (4, "!"), (4, "d"), (None, a)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long").repartition(3)
    got = sorted((r["doc_id"], r["class_id"], r["n_same"]) for r in neardup.near_duplicates(docs).collect() if r["doc_id"] is not None)
    assert got == sorted([(5, 5, 1), (5, 5, 2), (5, 5, 2), (7, 5, 1), (8, 5, 1), (9, 2, 2), (9, 2, 1), (2, 2, 2), (4, 4, 1), (4, 4, 1), (4, 4, 1)])
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep_first(spark, docs, "").collect()))
    assert kept == sorted([(5, a), (5, b), (2, c), (4, ""), (4, "!"), (4, "d"), (0, a)])
