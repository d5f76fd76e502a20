"""Operators whose results SQL can't give, against plain loops and exhaustive search on small inputs."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import chat, common, gif, langid, licenses, neardup, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---------------------------------------------------------------- chat


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    n, lines = len(chat.ROLES), 5
    hmm = chat.Hmm(rng.integers(0, 9, (chat.N_FEATURES, n)).astype(float), rng.integers(1, 9, (n, n)).astype(float), rng.random(n) + 0.1)
    scores, opens = rng.normal(size=(lines, n)), rng.random(lines) < 0.5
    best, back = chat.viterbi(scores[1:], opens[1:], hmm, hmm.start + scores[0])
    found = chat.trace(back, int(best.argmax()))

    def total(path):
        out = hmm.start[path[0]] + scores[0][path[0]]
        for t in range(1, lines):
            out += (hmm.between if opens[t] else hmm.within)[path[t - 1], path[t]] + scores[t][path[t]]
        return out

    every = max(itertools.product(range(n), repeat=lines), key=total)
    assert total(found) == pytest.approx(total(every)) and best.max() == pytest.approx(total(every))


def test_chat_of_one_turn_and_many_rows(spark, monkeypatch):
    """A conversation whose turns are all null, and one long one: places, blocks, and the same roles however it is cut."""
    rows = [(1, None, "user", f"User: question {k} here?") for k in range(40)] + [(2, k, ("user", "assistant")[k % 2], f"{('User', 'Assistant')[k % 2]}: line {k}") for k in range(60)] + [(None, 3, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {(r["conv_id"], r["turn"], r["rendered"]): (r["role_pred"], r["place"]) for r in chat.format_chats(df).collect()}
    monkeypatch.setattr(chat, "BLOCK", 7)
    cut = {(r["conv_id"], r["turn"], r["rendered"]): (r["role_pred"], r["place"]) for r in chat.format_chats(df).collect()}
    assert whole == cut and len(whole) == len(rows)
    assert sorted(p for (c, _, _), (_, p) in whole.items() if c == 1) == list(range(40))
    assert [p for (c, t, _), (_, p) in sorted((k, v) for k, v in whole.items() if k[0] == 2)] == list(range(60))


# ---------------------------------------------------------------- licenses


PIECES = ["under", "the", "mit", "license", "version", "2", "apache", "cc", "by", "nc", "gpl", "Under", "APACHE"]


@pytest.mark.parametrize("seed", range(4))
def test_phrases_in_fragments(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(150)]
    for phrase in licenses.PHRASES:
        part = phrase.split()
        texts += [" ".join(part[a:b]) for a in range(len(part)) for b in range(a, len(part) + 1)]
        texts += [f"x {phrase} {phrase}. y", f"{phrase.upper()}-{phrase}", " ".join(part[1:] + part)]
    texts += [None, "", "...", "license version 2", "the mit license version 2", "gpl license version 2"]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        w = words(text)
        places = [(at, label) for phrase, label in licenses.PHRASES.items() for at in range(len(w)) if w[at : at + len(phrase.split())] == phrase.split()]
        r = got[k]
        starts = [at for at, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None)), text
        base = sorted({x for _, x in places})
        assert r["base_labels"] == ",".join(base)
        assert set(base) <= set(r["labels"].split(",")) if base else True
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) >= bool(base)


def test_labels_that_only_the_automaton_finds(spark):
    """Whole templates, cut ones and ones with odd words put in get their label; fragments do not."""
    rows = []
    for label, texts in licenses.TEMPLATES.items():
        for text in texts:
            w = text.split()
            if len(w) < 12:
                continue
            rows.append((label, True, text))
            rows.append((label, True, " ".join(["so"] + w[: len(w) * 3 // 4])))
            rows.append((label, True, " ".join(x for k, y in enumerate(w) for x in ([y, "odd"] if k % 9 == 8 else [y]))))
            rows.append((label, False, " ".join(w[: len(w) // 4])))
    got = licenses.scan(spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(rows)], "doc_id long, text string")).collect()
    for r in got:
        label, there, text = rows[r["doc_id"]]
        if there:
            assert label in r["labels"].split(",") and 0.6 <= r["score"] <= 1, text
            assert r["n_base"] == text.lower().count("apache license, version 2.0"), text  # the only one that holds a phrase too
        else:
            assert label not in r["labels"].split(",") or r["n_base"], text


def chains_by_hand(scanner, w):
    """Share of each template that matches of LEAST words or more cover, going on within SKIP words on both sides."""
    keys = [int(x) for x in common.word_keys(" ".join(w))] if w else []
    out = set()
    for k in range(scanner.n_phrases, len(scanner.texts)):
        t = [int(x) for x in scanner.texts[k]]
        covered = set()
        for a in range(len(keys)):
            for b in range(len(t)):
                n = 0
                while a + n < len(keys) and b + n < len(t) and keys[a + n] == t[b + n]:
                    n += 1
                if n >= licenses.LEAST:
                    covered |= set(range(b, b + n))
        if len(covered) < licenses.COVERED * len(t):
            continue
        out.add(scanner.labels[k])
    return out


def test_no_label_without_cover(spark):
    """What the chains label, plain matching covers too."""
    rng, scanner = random.Random(5), licenses.Scanner()
    pool = [t.split() for texts in licenses.TEMPLATES.values() for t in texts]
    docs = []
    for _ in range(60):
        w = []
        for _ in range(rng.randrange(1, 4)):
            t = rng.choice(pool)
            a = rng.randrange(len(t))
            w += t[a : a + rng.randrange(1, len(t))] + ["filler"] * rng.randrange(4)
        docs.append(" ".join(w))
    for text, found in zip(docs, scanner.scan(pa.array(docs)), strict=True):
        assert {c[0] for c in found["chains"]} <= chains_by_hand(scanner, words(text))


# ---------------------------------------------------------------- language


def test_naive_bayes_by_dictionary(spark):
    rng = random.Random(3)
    letters = {"aa": "abcde éß", "bb": "cdefg 日本", "cc": "xyzab ñ"}
    docs = [(k, "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(3, 60))), lang) for k, lang in enumerate(rng.choice(list(letters)) for _ in range(300))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(df)
    import zlib

    counts, n_docs = defaultdict(Counter), Counter()
    for k, text, lang in docs:
        if zlib.crc32(str(k).encode()) % 5:
            ids, _, _ = langid.ngrams([text])
            counts[lang].update(int(x) for x in ids.ravel())
            n_docs[lang] += 1
    langs = sorted(counts)
    for k, text, _ in docs[:120] + [(0, "é", None), (0, "AB cd", None)]:
        ids, _, has = langid.ngrams([text])
        best = {}
        for lang in langs:
            score = math.log((n_docs[lang] + 1) / (sum(n_docs.values()) + len(langs)))
            for order in range(len(langid.ORDERS)):
                low, high = order * langid.BUCKETS, (order + 1) * langid.BUCKETS
                total = sum(n for x, n in counts[lang].items() if low <= x < high) + 0.1 * langid.BUCKETS
                score += sum(math.log((counts[lang][int(x)] + 0.1) / total) for x in ids.ravel() if low <= x < high)
            best[lang] = score
        order = sorted(best.values())
        if order[-1] - order[-2] > 1e-3:
            assert model.score([text])[0] == [max(best, key=best.get) if has[0] else "und"]


def test_callers_columns_stay(spark):
    docs = spark.createDataFrame([(1, "ab cd", "x", "kept"), (2, None, "y", "kept")], "doc_id long, text string, lang_both string, _lang string")
    got = langid.identify(docs, langid.Model(["q"], np.ones((1, 2 * langid.BUCKETS)), np.ones(1))).collect()
    assert [(r["_lang"], r["lang_both"]) for r in got] == [("kept", "x"), ("kept", "y")]


# ---------------------------------------------------------------- toxicity


def test_forward_pass_by_loops():
    rng = np.random.default_rng(2)
    net = toxicity.Net(np.sort(common.word_keys("a b c d")), seed=5)
    for v in net.p.values():
        v += rng.normal(size=v.shape).astype(np.float32) * 0.3
    texts = ["a b xyz c a d d q", "c", "", "b " * 90]
    col = pa.array(texts)
    h, p, soft = toxicity.HIDDEN, net.p, lambda x: x / (1 + abs(x))
    w = common.Words(col)
    ids, grams, first, inverse = net.inputs(w)
    x = net.vectors(ids, grams, first)

    def logit(seq):
        states = np.zeros((len(seq), 2 * h))
        for d, k in enumerate("fb"):
            s = np.zeros(h)
            for t in range(len(seq)) if k == "f" else reversed(range(len(seq))):
                a, b = seq[t] @ p["x" + k] + p["c" + k], s @ p["u" + k]
                z, r = (0.5 + 0.5 * soft(a[i * h : (i + 1) * h] + b[i * h : (i + 1) * h]) for i in (0, 1))
                c = soft(a[2 * h :] + r * b[2 * h :])
                s = z * s + (1 - z) * c
                states[t, d * h : (d + 1) * h] = s
        if not len(seq):
            return float(p["bias"][0])
        e = states @ p["att"]
        e = np.exp(e - e.max())
        return float((e / e.sum()) @ states @ p["out"] + p["bias"][0])

    want = []
    for k in range(len(texts)):
        own = x[inverse[w.first[k] : w.first[k + 1]]] if w.first[k + 1] > w.first[k] else np.zeros((0, x.shape[1]))
        starts = range(0, max(1, len(own) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if len(own) > toxicity.WINDOW else [0]
        want.append(max(logit(own[a : a + toxicity.WINDOW]) for a in starts))
    assert net.logits(col) == pytest.approx(want, abs=2e-4)


# ---------------------------------------------------------------- near duplicates


def jaccard(a, b):
    def bag(t):
        w = words(t)
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def test_recall_on_planted_copies(spark):
    """Every pair at 0.8 or more, found by comparing all, lies in one class: chains of edits, shared passages, repeats."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((30, 60, 120, 300)))] for _ in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    docs = []
    for k, w in enumerate(base):
        docs.append(w)
        for _ in range(rng.randrange(8)):
            w = list(w)
            for _ in range(rng.choice((1, 1, 2, 3, max(1, len(w) // 20)))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(w)
        docs.append(w * 2 if k % 9 == 0 else w[: len(w) * 9 // 10])
        docs.append(passage + [rng.choice(vocabulary) for _ in range(20)])  # alike, but not enough
    texts = [" ".join(w) for w in docs]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    pairs = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        if jaccard(texts[a], texts[b]) >= 0.8:
            pairs += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert pairs > 150
    assert {k: find(k) for k in range(len(texts))} == got


# ---------------------------------------------------------------- media


def test_histogram_by_loops(spark):
    text = "Some words, ÄÖ 日本 and more of them. " * 3
    row = gif.digest(gif.store(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    payload = text.encode().ljust(-(-len(text.encode()) // 64) * 64, b"\0")
    bins = Counter(v >> 2 for v in payload)
    want = sorted(bins.items(), key=lambda x: (-x[1], x[0]))[:8]
    assert row["feature"] == ",".join(f"{k}:{n}" for k, n in want) and row["payload_bytes"] == len(payload)
    assert len({gif.COLOURS[k : k + 3] for k in range(0, 768, 3)}) == 256
