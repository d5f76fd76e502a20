"""Numbers that the reference's own tests expect, and small cases worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.functions import codec, identity
from graphloom.functions import predicates as pred
from graphloom.functions import text as T
from graphloom.operators import communities, context, iterative, merkle, quality, search, store
from graphloom.sources import ownership

NOW, DAY = 1_735_689_600, 86_400
RANKED = "symbol string, callers long, confidence double, last_observed long, last_commit_at long, distance int, feedback double, session double, is_test boolean"


def rank(spark, *rows, **how):
    out = context.rank(spark.createDataFrame(rows, RANKED), NOW, **how)
    return {r["symbol"]: r.asDict() for r in out.collect()}


def test_ranking_weights(spark):
    got = rank(spark, ("full", 50, 0.9, NOW, 0, 0, 0.0, 0.0, False))["full"]
    assert got["score"] == pytest.approx(0.975, abs=1e-6)
    got = rank(spark, ("high", 50, 0.5, 0, 0, 0, 0.0, 0.0, False), ("low", 1, 0.5, 0, 0, 0, 0.0, 0.0, False))
    assert (got["high"]["blast_radius"], got["low"]["blast_radius"]) == (0.4, 0.008)
    got = rank(spark, ("a", 0, 1.0, NOW, 0, 0, 0.0, 0.0, False), ("b", 0, 0.7, 0, 0, 1, 0.0, 0.0, False), ("c", 100, 0.5, 0, 0, 0, 0.0, 0.0, False))
    assert (got["a"]["confidence_part"], got["b"]["confidence_part"]) == (0.25, 0.175)
    assert (got["a"]["recency"], got["b"]["recency"]) == (0.2, 0.06)
    assert (got["a"]["nearness"], got["b"]["nearness"], got["c"]["blast_radius"]) == (0.15, 0.075, 0.4)


def test_ranking_parts(spark):
    rows = [(f"f{k}", 0, 0.0, 0, 0, 0, k / 4, 0.0, False) for k in range(5)]
    assert [r["feedback_part"] for r in rank(spark, *rows).values()] == [0.0, -0.025, 0.0, 0.125, 0.25]
    ages = [0, 1, 2, 7, 8, 30, 31]
    got = rank(spark, *((f"a{k}", 0, 0.0, NOW - d * DAY, NOW - d * DAY, 0, 0.0, k / 3.5, False) for k, d in enumerate(ages)))
    assert [round(r["recency"] / 0.2, 6) for r in got.values()] == [1.0, 1.0, 0.8, 0.8, 0.5, 0.5, 0.2]
    assert [r["commit"] for r in got.values()] == [0.05, 0.05, 0.03, 0.03, 0.01, 0.01, 0.0]
    assert got["a6"]["session_part"] == pytest.approx(0.2 * (6 / 3.5) / 2, abs=1e-6)
    whole, test = rank(spark, ("x", 9, 1.0, NOW, 0, 0, 0.0, 0.0, False), ("y", 9, 1.0, NOW, 0, 0, 0.0, 0.0, True)).values()
    assert test["score"] == pytest.approx(0.15 * whole["score"], abs=1e-6)


def test_hubs_move_the_score(spark):
    schema = RANKED + ", authority double, hub double"
    rows = [("seed", 10, 0.5, 0, 0, 0, 0.0, 0.0, False, 0.4, 0.2), ("far", 10, 0.5, 0, 0, 1, 0.0, 0.0, False, 0.4, 0.2), ("none", 10, 0.5, 0, 0, 0, 0.0, 0.0, False, 0.05, 0.1)]
    got = {r["symbol"]: r["hub_part"] for r in context.rank(spark.createDataFrame(rows, schema), NOW, hubs=True).collect()}
    assert got == {"seed": 0.12, "far": -0.06, "none": 0.0}


FEEDBACK = "symbol_hash string, useful int, neighborhood_root string, keyword_cluster string"


def test_feedback_boosts(spark):
    rows = [("a", 1, None, None), ("a", 1, None, None), ("b", 1, None, None), ("b", 0, None, None)]
    of = lambda df, *a: {r["symbol_hash"]: r["boost"] for r in store.feedback_boosts(df, *a).collect()}
    df = spark.createDataFrame(rows, FEEDBACK)
    assert of(df) == {"a": 1.0, "b": 0.5}
    assert of(df, "linear") == {"a": round(0.5 + 0.5 * 2 / 3, 6), "b": 0.5}
    root2 = 1 - 1 / (1 + 2**0.5)
    assert of(df, "sqrt")["a"] == round(0.5 + 0.5 * root2, 6) and of(df, "asym")["a"] == 1.0
    bad = spark.createDataFrame([("c", 0, None, None)] * 2, FEEDBACK)
    assert of(bad, "asym")["c"] == round(0.5 - 0.5 * root2, 6) and of(bad) == {"c": 0.0}


def test_feedback_expires_with_its_root(spark):
    rows = [("a", 1, "v1", None), ("a", 1, "v1", None)]
    roots = lambda r: spark.createDataFrame([("a", r)], "symbol_hash string, root string")
    of = lambda rows, r: {x["symbol_hash"]: x["boost"] for x in store.feedback_boosts(spark.createDataFrame(rows, FEEDBACK), "none", roots(r)).collect()}
    assert of(rows, "v1") == {"a": 1.0} and of(rows, "v2") == {}
    assert of(rows + [("a", 0, "v2", None)], "v2") == {"a": 0.0}
    assert of(rows + [("a", 0, None, None)], "v2") == {"a": 0.0}


@pytest.mark.parametrize(
    "pattern, path, want",
    [
        ("*.go", "main.go", True), ("*.go", "internal/a/b.go", True), ("*.go", "main.py", False), ("internal/", "internal/a/b.go", True), ("internal/", "cmd/internal/a.go", False), ("/docs/", "docs/x.md", True),
        ("**/test_*.go", "a/b/test_x.go", True), ("**/test_*.go", "test_x.go", True), ("**/test_*.go", "a/xtest_x.go", False), ("internal/**/x.go", "internal/a/b/x.go", True), ("internal/**/x.go", "cmd/a/x.go", False),
        ("/cmd/*.go", "cmd/a.go", True), ("/cmd/*.go", "x/cmd/a.go", False), ("a/b.go", "x/a/b.go", True), ("a/b.go", "xa/b.go", False), ("?.py", "x.py", True), ("[ab].py", "dir/b.py", True), ("[ab].py", "c.py", False),
    ],
)
def test_owner_patterns(spark, pattern, path, want):
    rules = ownership.rules_frame(spark, [(pattern, ["@x"])])
    assert (store.owned(spark.createDataFrame([(path,)], "path string"), rules).count() > 0) is want


def test_codeowners_text():
    text = "# comment\n\n*.go @backend-team\n/docs/ @docs\ninternal/api/  @a @b\nlonely\n"
    assert ownership.parse_codeowners(text) == [("*.go", ["@backend-team"]), ("/docs/", ["@docs"]), ("internal/api/", ["@a", "@b"])]
    assert ownership.parse_codeowners("") == []


def test_keywords():
    assert T.keywords("add a `before_request` hook").exact == ["before_request"]
    assert "get_queryset" in T.keywords("fix the get_queryset method").compounds
    assert {"SessionHandler", "sessionhandler"} <= set(T.keywords("refactor SessionHandler middleware").compounds)
    k = T.keywords("compute blast radius for this module")
    assert {"BlastRadius", "blast_radius"} <= set(k.components) and not set(k.compounds) & {"BlastRadius", "blast_radius"}
    assert T.keywords("") == T.Keywords()
    assert {"AuthService", "SessionStore"} <= set(T.keywords("connect `AuthService` to `SessionStore`").exact)
    k = T.keywords("Add a new before_request hook that validates API keys from the Authorization header before each request")
    assert "before_request" in k.compounds and not {"hook", "validates", "header", "request"} & set(k.compounds + k.exact)
    assert T.keywords("fix ctx handling").components[:2] == ["ctx", "Ctx"] and "context" in T.keywords("parse ctx handling").components
    assert T.code_references("call ModelAdmin.get_inlines and html.escape() but not foo.bar, e.g. 3.9") == ["ModelAdmin.get_inlines", "get_inlines", "html.escape", "escape"]
    assert T.path_terms("update the EndpointSlice reconciler in controller") == ["endpointslice", "reconciler", "controller", "endpoint", "slice"]
    assert T.decomposed(["django.utils.html.escape", "before_request", "plain"]) == [("symbol_name", "html"), ("symbol_name", "escape"), ("symbol_name", "before"), ("symbol_name", "request"), ("", "plain")]


def test_words_of_names(spark):
    c = lambda f, *xs: [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x string").select(f(F.col("x"))).collect()]
    assert c(T.camel_parts, "TraceIngestor", "HTMLParser", "SQLiteStore", "aB", "x") == [["Trace", "Ingestor"], ["HTML", "Parser"], ["SQ", "Lite", "Store"], [], []]
    assert c(T.search_tokens, "before_request.runNow(a)", None) == ["before_request before request runNow run Now a", ""]
    assert c(T.symbol_name, "github.com/django/django://django/db/models/query.py.QuerySet.filter", "repo://pkg/sub.Type.Method", "bare") == ["QuerySet.filter", "sub.Type.Method", "bare"]
    assert c(T.path_concepts, "src/compiler/commandLineParser.ts", "src/flask/a_long_name.py") == ["compiler compiler command Line Parser commandLineParser", "flask flask a_long_name a_long_name"]
    assert c(identity.package_of, "r://a/b.T.m", "none") == ["a/b", None]
    assert c(lambda x: T.path_match(x, "migration"), "r://django/db/migrations/base.py.Op", "r://a/x.py.migration", "r://a/immigration/x.py.f") == [True, False, False]
    assert c(T.seed_package, "g://a/b.Type.m", "g://a.b.c", "g://Up.x") == ["a/b", "a.b.c", "Up.x"]


def test_change_classes(spark):
    def of(*rows):
        return merkle.classify(spark.createDataFrame(rows, "package_path string, change string, edge_types array<string>")).first()["class"]

    assert of(("p", "changed", ["imports", "calls"])) == "behavioral"
    assert of(("p", "changed", ["imports", "runtime_rpc"])) == "runtime_drift"
    assert of(("p", "changed", ["implements"])) == of(("p", "removed", [])) == of(("p", "added", ["references"])) == "structural"
    assert of(("p", "changed", ["references"])) == "metadata_only"
    assert merkle.classify(spark.createDataFrame([], "package_path string, change string, edge_types array<string>")).first()["class"] == "no_change"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 31, 64, 65])
def test_roots_in_blocks(spark, n):
    rows = [("p", "calls", hashlib.sha256(f"{n}-{k}".encode()).hexdigest()) for k in range(n)] + [("p", "imports", hashlib.sha256(b"i").hexdigest()), ("", "calls", hashlib.sha256(b"j").hexdigest())]
    edges = spark.createDataFrame(rows + rows[:1], "package_path string, edge_type string, edge_hash string").repartition(5)
    types, packages = merkle.roots(edges, block=4)
    got = {(r["package_path"], r["edge_type"]): (r["root"], r["leaves"]) for r in types.collect()}
    leaves = lambda p, t: [bytes.fromhex(h) for a, b, h in rows if (a, b) == (p, t)]
    want = {(p, t): merkle.fold(leaves(p, t)) for p, t in {r[:2] for r in rows}}
    assert got == {(p or "_root", t): (h.hex(), len(leaves(p, t))) for (p, t), h in want.items()}
    package = {p: merkle.fold([h for (a, _), h in want.items() if a == p]) for p in ("p", "")}
    assert {r["package_path"]: r["root"] for r in packages.collect()} == {p or "_root": h.hex() for p, h in package.items()}
    root = merkle.fold(list(package.values()), True).hex()
    assert merkle.repo_root(packages).first()["root"] == root
    if n in (1, 9, 31):
        for h in {rows[0][2], rows[n - 1][2]}:
            found = merkle.prove(edges, h, "p", "calls", block=4)
            assert merkle.verify_proof(found) and found["repo_root"] == root
            assert not merkle.verify_proof({**found, "edge": hashlib.sha256(b"other").hexdigest()})
        gone = merkle.prove_absence(edges, hashlib.sha256(b"absent").hexdigest(), "p", "calls", block=4)
        assert merkle.verify_absence(gone) and gone["repo_root"] == root
        with pytest.raises(ValueError):
            merkle.prove_absence(edges, rows[0][2], "p", "calls", block=4)
        assert merkle.prove_absence(edges, rows[0][2], "nowhere", "calls", block=4) == {"missing": rows[0][2], "left": None, "right": None, "repo_root": root}


def test_codecs():
    pack = {"tool": "context_for_task", "tokens_used": 300, "token_budget": 4000, "symbols": [{"qualified_name": "r://a.é", "kind": "function", "score": 0.5, "provenance": "ast_resolved", "distance": 1, "signature": "f()", "components": {"blast_radius": 0.25, "confidence": 0.5, "recency": 0.0, "distance": 1.0}}, {"qualified_name": "r://b", "kind": "type", "score": 2.0, "provenance": "structural", "distance": 0, "signature": "", "components": {p: 0.0 for p in codec.PARTS}}], "edges": [{"source": "r://a.é", "target": "r://b", "edge_type": "calls", "status": "added"}]}
    for name in codec.names():
        c = codec.get(name)
        assert c.decode(c.encode(pack)) == pack
    assert codec.to_binary(pack)[:5] == b"GCB1\1" and codec.EDGE_TYPES.index("executes_process") == 37
    for broken in (b"", b"XXXX\1", codec.to_binary(pack)[:-3]):
        with pytest.raises(ValueError):
            codec.from_binary(broken)
    with pytest.raises(ValueError):
        codec.get("none")
    assert codec.unsqueeze(codec.squeeze("text é")) == "text é"
    assert context.render([{"qualified_name": "a<b>", "kind": "type", "score": 1.0}], 'say "x" & y').startswith('<context task="say &quot;x&quot; &amp; y">\n  <symbol name="a&lt;b&gt;"')


def test_statistics():
    assert quality.wilcoxon([]) == quality.wilcoxon([0.0, 0.0]) == 1.0
    assert quality.wilcoxon([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) == pytest.approx(0.005062, abs=1e-5)
    assert quality.cohens_d([0.1] * 5) == 10.0 and quality.cohens_d([-0.1] * 5) == -10.0 and quality.cohens_d([0.0]) == 0.0
    assert quality.cohens_d([1.0, 2.0, 3.0]) == 2.0
    low, high = quality.bootstrap([1.0, 2.0, 3.0, 4.0] * 10)
    assert 2.0 < low < 2.5 < high < 3.0


def test_packs(spark):
    rows = [("a", "f1", 0.9, 9, 1.0, False), ("b", "f1", 0.5, 1, 1.0, False), ("c", "f2", 0.8, 4, 0.01, False), ("d", "f2", 0.1, 1, 1.0, False)]
    df = spark.createDataFrame(rows, "symbol string, file string, score double, cost long, rwr double, external boolean")
    of = lambda *a, **b: [r["symbol"] for r in context.pack(df, *a, **b).collect()]
    assert of(6) == ["c", "b", "d"] and of(10) == ["a", "b"] and of(10, "top-k") == ["a", "b"]
    assert of(5, "file") == ["c", "d"] or of(5, "file") == ["c", "b"]
    assert context.proximity_exponent(0, 5) == 0.3 and context.proximity_exponent(10, 5) == 0.7 and context.proximity_exponent(99, 5) == 0.7
    assert context.worth_it(59, 100) and not context.worth_it(60, 100) and not context.worth_it(0, 0)
    hashes = [hashlib.sha256(x).hexdigest() for x in (b"1", b"2")]
    assert context.pack_root(" Fix It ", hashes) == context.pack_root("fix it", hashes[::-1])


def test_incremental_communities(spark):
    edges = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(3, 10, 1.0), (20, 0, 1.0), (20, 1, 1.0)]
    df = spark.createDataFrame(edges, "u long, v long, w double")
    former = {n: n // 10 for n in [*range(4), *range(10, 14)]}
    got = {r["node"]: r["community"] for r in iterative.louvain(df, former=former, changed={20}).collect()}
    assert got[20] == got[0] == got[3] and got[10] == got[13] != got[0]
    same = {r["node"]: r["community"] for r in iterative.louvain(df, former=former, changed=set()).collect()}
    assert len({same[n] for n in (0, 10, 20)}) == 3
    labels = spark.createDataFrame(list(former.items()), "node long, label long")
    got = {r["node"]: r["label"] for r in communities.propagate_from(df, labels, spark.createDataFrame([], "node long")).collect()}
    assert got[20] == 0 and {got[n] for n in range(10, 14)} == {1}
    with pytest.raises(ValueError):
        communities.detect(df, "other")


def test_equivalents_and_plans():
    classes = [{"concept": "A", "phrases": ["email validation", "mail"], "targets": ["X"], "weight": 1.0, "lang": "python"}, {"concept": "B", "phrases": ["command"], "targets": ["Y"], "weight": 0.9}]
    got = T.equivalents("Add EMAIL validation command", classes, "python")
    assert [(c["concept"], c["strong"]) for c in got] == [("A", True), ("B", False)]
    assert [c["concept"] for c in T.equivalents("email command", classes, "go")] == ["B"]
    assert T.expanded(["queue", "worker"], {"queue": ["worker", "broker"], "worker": ["runner", "pool"]}, 2) == ["broker", "runner"]
    assert T.plan("review the pull request") == ["context_for_pr"] and T.plan("hello") == ["context_for_task"]
    assert pred.is_test_task("Write unit tests") and not pred.is_test_task("parse input")
    assert T.with_verbs(["blast radius", "find x"], ["find"]) == ["blast radius", "find x", "find blast radius"]


def test_peakedness(spark):
    of = lambda xs: search.peakedness(spark.createDataFrame([(float(x),) for x in xs], "score double")).first()["confidence"]
    assert of([1] * 9) == 1.0 and of([1] * 10) == 0.0 and of([4] + [1] * 9) == 1.0 and of([2.1] + [1] * 9) == 0.5 and of([0] * 12) == 0.0
