"""Predicates on names, paths and tasks, as Column expressions; single strings are judged in Python."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path and name parts by which symbols are noise or tests, and words that say so.
NOISE_PARTS = ("/dist/", "/build/", "/vendor/", "/node_modules/", ".min.", ".bundle.", "conftest.py.", "fixtures.py.", "/testutil", "/testhelper", "test_helper")
DOUBLES = ("mock", "fake", "stub")
SHORT_NAMES = ("ID", "OK", "Go", "Do", "DB", "IP", "IO")
TEST_WORDS = ("test", "testing", "spec", "unit test", "integration test", "mock", "fixture", "assert")
CO_TEST_PARTS = ("_test.go", "/tests/", "/test/", "_test.py", "_test.ts", "_test.rs", ".test.ts", ".test.js", ".spec.ts", ".spec.js", "test_")
CO_TEST_ENDS = ("tests.py", "test.java", "tests.java")
SUPPLY_PARTS = (
    "/test/", "/tests/", "/__tests__/", "/spec/", "_test.go", ".test.", ".spec.", "/test_", "tests/test_", "conftest.py",
    "/benchmark/", "/benchmarks/", "/example/", "/examples/", "/fixtures/", "/testdata/",
)
STOP_WORDS = (
    "the a an in to for is of and or on at by it be as do no if so up my we all this that with from what how can will should would "
    "about into when where which new get set add make init has err func type var const return import package struct interface "
    "string int bool error nil refactor fix update change modify implement create delete remove move improve optimize review"
).split()
VOCAB_NOISE = (
    "use uses used using find finds found finding write writes written writing read reads reading run runs running call calls called "
    "calling send sends sent sending take takes taken taking make makes made making show shows shown showing check checks checked "
    "checking allow allows allowed allowing add adds added adding handle handles handled handling raise raises raised raising return "
    "returns returned returning not also only just whether instead already still properly correctly currently multiple various "
    "different specific certain given related similar understand ensure determine support supports needs works working value values "
    "data result results output input inputs argument arguments case cases issue issues problem way part thing method methods "
    "function functions class classes object objects file files code test tests when where after before between during without "
    "within through against around"
).split()
LANGUAGES = (("go", (".go.",)), ("python", (".py.",)), ("typescript", (".ts.", ".tsx.")), ("ruby", (".rb.",)), ("java", (".java.",)), ("csharp", (".cs.",)), ("rust", (".rs.",)), ("java", ("://org.", "://com.", "://io.", "://net.")))
BENIGN = "node node.exe npm npx yarn pnpm python python3 pip pip3 go cargo rustc javac tsc git sh bash zsh worker_threads cluster.fork".split()


def has_any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def noise(qualified: Column, kind: Column | None = None) -> Column:
    """External and library symbols, bundles and build output, test helpers, doubles by their type's name, and names of
    one or two bytes that are no usual ones."""
    low = F.lower(qualified)
    owner = F.lower(F.regexp_extract(qualified, r"\.([^.]*)\.[^.]*$", 1))
    name = F.substring_index(qualified, ".", -1)
    short = qualified.contains(".") & (F.octet_length(name) <= 2) & ~name.isin(*SHORT_NAMES)
    out = qualified.startswith("external://") | qualified.startswith("stdlib://") | has_any(low, NOISE_PARTS) | has_any(owner, DOUBLES) | short
    return out if kind is None else (F.coalesce(kind, F.lit("")) == "external") | out


def ranking_test(qualified: Column) -> Column:
    """Whether ranking takes a symbol for one of a test file."""
    low = F.lower(qualified)
    sharp = low.contains("tests/") & has_any(low, ("unittests/", "acceptancetests/", "integrationtests/", ".tests/"))
    return has_any(low, ("_test.go", "/tests/", ".test.", ".spec.", "/__tests__/", "/test/", "/src/test/")) | (low.contains("/test_") & low.contains(".py")) | sharp


def co_test(path: Column) -> Column:
    """Whether a path is a test file for co-tested pairs."""
    low = F.lower(path)
    return has_any(low, CO_TEST_PARTS) | reduce(lambda a, b: a | b, (low.endswith(x) for x in CO_TEST_ENDS))


def supply_test(path: Column) -> Column:
    """Whether a path is of tests, benchmarks or examples for the supply-chain audit."""
    return has_any(F.lower(path), SUPPLY_PARTS)


def test_function(kind: Column, qualified: Column) -> Column:
    name = F.substring_index(qualified, ".", -1)
    return (kind == "function") & (name.startswith("Test") | name.startswith("Benchmark"))


def is_test_task(text: str) -> bool:
    return any(w in text.lower() for w in TEST_WORDS)


def vocab_worthy(word: Column) -> Column:
    return (F.octet_length(word) >= 4) & ~word.isin(*VOCAB_NOISE, *STOP_WORDS)


def benign_process(target: Column) -> Column:
    return F.lower(F.substring_index(target, "/", -1)).isin(*BENIGN)


def edge_allowed(edge_type: Column, allowed: list[str]) -> Column:
    """All kinds if none are listed."""
    return edge_type.isin(*allowed) if allowed else F.lit(True)


def language(qualified: Column) -> Column:
    """The first language whose mark a name holds; null if none."""
    out = F.lit(None).cast("string")
    for name, marks in reversed(LANGUAGES):
        out = F.when(has_any(qualified, marks), name).otherwise(out)
    return out


def mixed_case(text: Column) -> Column:
    return text.rlike("[A-Z]") & text.rlike("[a-z]")


def _match_one(glob: str) -> str:
    """A shell pattern without `/` across stars, as a regular expression."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            out, k = out + "[" + glob[k + 1 : end].replace("\\", "\\\\") + "]", end
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out += re.escape(glob[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def owners_regex(pattern: str) -> str:
    """A regular expression for a CODEOWNERS pattern, to be found anywhere in a path.

    `dir/` is a folder and all in it, from the root; `a/**/b` any b below a; a leading `/` anchors; a pattern without a
    slash is a file's name; any other matches from any folder on.
    """
    if pattern.endswith("/"):
        return "^" + re.escape(pattern.strip("/")) + "(/|$)"
    bare = pattern.removeprefix("/")
    if "**/" in bare:
        before, after = bare.split("**/", 1)
        return ("^(?=" + re.escape(before) + ")" if before else "^") + "(.*/)?" + _match_one(after) + "$"
    if pattern.startswith("/"):
        return "^" + _match_one(bare) + "$"
    return "(^|/)" + _match_one(pattern) + "$"
