"""Words of names, paths and tasks: Column expressions for tables, plain Python for the one task that is asked about."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.predicates import STOP_WORDS

# Extensions after which a symbol's name begins, folders that name nothing, verbs and fillers of tasks,
# what abbreviations stand for, words too common for a path or a phrase.
EXTENSIONS = (".go.", ".py.", ".ts.", ".js.", ".rs.", ".java.", ".cs.", ".rb.", ".sql.", ".proto.")
PLAIN_FOLDERS = ("src", "lib", "internal", "pkg", ".", "")
VERBS = "add implement create build fix refactor update change remove delete move find detect compute generate resolve wire connect extend introduce integrate".split()
FILLERS = "a an the new existing all some each that which".split()
ABBREVIATIONS = {
    "ctx": "context", "fmt": "format", "req": "request", "resp": "response", "res": "response", "cfg": "config", "conf": "config",
    "msg": "message", "db": "database", "srv": "server", "svc": "service", "mgr": "manager", "pkg": "package", "idx": "index",
    "iter": "iterator", "buf": "buffer", "conn": "connection", "addr": "address", "auth": "auth", "mux": "multiplexer",
    "cmd": "command", "args": "arguments", "opts": "options", "params": "parameters", "desc": "description",
    "info": "information", "stat": "statistics", "stats": "statistics",
}
PATH_STOPS = set(
    "about above after again also always based because been before being between both called change check code could create custom "
    "data debug default does doing done during each ensure every existing extend field file find first following from function given "
    "have here high implement into just keep know large like list look make many method more most much must name need never node only "
    "open other over part pass path place point read request result return right same should show since single some specific start "
    "state step still support system take test text that then there these they thing this through time trace tracing type under update "
    "used using value very want well what when where which while will with within without work would write zero adding added calls "
    "handle handling level logic main module object operation option order perform process provide running service setting source "
    "string class model view base error response down".split()
)
GENERIC = set("handle new get set is has do run make init test mock err ctx ok the for with from and func type string int bool error".split())
ALIAS_GENERIC = GENERIC | set("server store require optional args result".split())
CONCEPT_GENERIC = GENERIC | {"nil", "true", "false"}
EDGES = ".,;:!?\"'`()[]{}#"


# ---------------------------------------------------------------- columns


def camel_parts(text: Column) -> Column:
    """Parts of an identifier of two bytes or more: a new one where lower turns upper, and ahead of an upper that a lower
    follows."""
    return F.filter(F.split(text, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"), lambda w: F.octet_length(w) >= 2)


def search_tokens(text: Column) -> Column:
    """A name with its camel and snake parts beside it, for the text index."""
    none = F.array().cast("array<string>")

    def parts(s: Column) -> Column:
        camel = camel_parts(s)
        snake = F.filter(F.split(s, "_"), lambda p: (p != "") & (p != s))
        return F.concat(F.array(s), F.when(F.size(camel) > 1, camel).otherwise(none), F.when(s.contains("_"), snake).otherwise(none))

    segments = F.filter(F.split(F.coalesce(text, F.lit("")), r"[/.:(), *]+"), lambda s: s != "")
    return F.array_join(F.flatten(F.transform(segments, parts)), " ")


def symbol_name(qualified: Column) -> Column:
    """What stands after the package: past the last `://`, the last slash, and the first known extension."""
    name = F.substring_index(F.substring_index(qualified, "://", -1), "/", -1)
    out = name
    for ext in reversed(EXTENSIONS):
        out = F.when(name.contains(ext), F.substring(name, F.instr(name, ext) + len(ext), F.length(name))).otherwise(out)
    return out


def path_concepts(path: Column) -> Column:
    """Words of a path's folders and file, extensions and plain folders left out."""
    none = F.array().cast("array<string>")
    long_ = lambda w: F.octet_length(w) >= 3

    def words(part: Column) -> Column:
        bare = F.when(F.locate(".", part, 2) > 0, F.regexp_replace(part, r"\.[^.]*$", "")).otherwise(part)
        camel = camel_parts(bare)
        snake = F.when(bare.contains("_"), F.split(bare, "_")).otherwise(F.array(bare))
        out = F.when(F.size(camel) == 0, snake).otherwise(F.concat(camel, F.array(bare)))
        return F.filter(F.when(F.lower(part).isin(*PLAIN_FOLDERS), none).otherwise(out), long_)

    return F.array_join(F.flatten(F.transform(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), words)), " ")


def words_of(text: Column) -> Column:
    """Terms as the text index has them: runs of letters, digits and `_`, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def seed_package(qualified: Column) -> Column:
    """Dotted parts after `://` up to the first that begins upper-case; the whole if that leaves none."""
    path = F.when(F.instr(qualified, "://") > 0, F.substring(qualified, F.instr(qualified, "://") + 3, F.length(qualified))).otherwise("")
    parts = F.filter(F.split(path, r"\."), lambda p: p != "")
    upper = F.transform(parts, lambda p: p.rlike("^[A-Z]"))
    stop = F.array_position(upper, True)
    before = F.when(stop > 0, F.slice(parts, 1, (stop - 1).cast("int"))).otherwise(parts)
    return F.when(F.size(before) == 0, path).otherwise(F.array_join(before, "."))


def path_portion(qualified: Column) -> Column:
    """A lower-cased name up to the end of its file's extension, or up to the first dot after the last slash."""
    low = F.lower(qualified)
    last = F.substring_index(low, "/", -1)
    out = F.when(low.contains("/") & last.contains("."), F.regexp_replace(low, r"\.[^/]*$", "")).otherwise(low)
    for ext in (".js.", ".rb.", ".cs.", ".java.", ".ts.", ".rs.", ".go.", ".py."):
        out = F.when(low.contains(ext), F.regexp_extract(low, "^(.*" + re.escape(ext) + ")", 1)).otherwise(out)
    return out


def path_match(qualified: Column, term: str) -> Column:
    """Whether a term's first place in the path begins a segment."""
    path = path_portion(qualified)
    at = F.instr(path, term.lower())
    before = F.substring(path, at - 1, 1)
    return (at == 1) | ((at > 1) & before.isin("/", ".", "_", "-", ":"))


# ---------------------------------------------------------------- one task


def mixed(text: str) -> bool:
    return bool(re.search("[A-Z]", text) and re.search("[a-z]", text))


def identifier_parts(text: str) -> list[str]:
    """Snake parts, or else parts that each begin with an upper-case letter."""
    if "_" in text:
        return [p for p in text.split("_") if p]
    return re.findall("[A-Z]?[^A-Z]*", text)[:-1] if text else []


def is_compound(word: str) -> bool:
    return "_" in word or "." in word or mixed(word)


def code_references(task: str) -> list[str]:
    """Calls, dotted names of a class, and dotted names with an underscore, each with its last part."""
    out: dict[str, None] = {}
    for raw in task.split():
        word = raw.rstrip(",;:!?\"'`]}").lstrip("\"'`([{")
        call = word.endswith("()")
        word = (word[:-2] if call else word).lstrip(".")
        if len(word) < 3 or word.lower() in ("e.g", "i.e", "etc", "vs", "eg", "ie") or re.fullmatch("[0-9.]*", word):
            continue
        dotted = "." in word
        if call or (dotted and (re.match("[A-Z]", word) or "_" in word)):
            for name in (word, word.rsplit(".", 1)[-1]) if dotted else (word,):
                if 3 <= len(name) <= 100:
                    out.setdefault(name)
    return list(out)


@dataclass
class Keywords:
    """What a task names: quoted names, compound identifiers, and single words with likely joins of neighbours."""

    exact: list[str] = field(default_factory=list)
    compounds: list[str] = field(default_factory=list)
    components: list[str] = field(default_factory=list)

    @property
    def primary(self) -> list[str]:
        return self.exact + self.compounds

    @property
    def all(self) -> list[str]:
        return self.primary + self.components


def keywords(task: str) -> Keywords:
    """Each word stands once, where it was found first; equally long components keep their order."""
    out, seen = Keywords(), set()

    def put(where: list[str], *words: str) -> None:
        for w in words:
            if w and w not in seen:
                seen.add(w)
                where.append(w)

    for quoted in re.findall("`([^`]*)`", task):
        name = quoted.strip()
        if name and len(name) <= 100 and " " not in name:
            put(out.exact, name, name.lower())
    for name in code_references(task):
        put(out.compounds, name, name.lower())
    words = task.split()
    first: list[str] = []
    target = next((w for w in (x.strip(EDGES) for x in words[1:]) if w and w.lower() not in FILLERS), None)
    if words and words[0].strip(EDGES).lower() in VERBS and target:
        low = target.lower()
        if "_" in low or "." in low or mixed(target):
            put(out.compounds, low, target if mixed(target) else "")
        else:
            put(first, low, low[:1].upper() + low[1:] if len(low) > 2 else "")
    single: list[str] = []
    for word in (w.strip(EDGES) for w in words):
        parts, low = identifier_parts(word), word.lower()
        if "_" in low or "." in low or len(parts) > 1:
            put(out.compounds, low if low not in STOP_WORDS else "", word if mixed(word) else "")
        for part in (p.lower() for p in parts):
            if len(part) >= 2 and part not in STOP_WORDS and part not in seen:
                put(single, part, ABBREVIATIONS.get(part, ""))
    clean = [w for w in (x.strip(EDGES).lower() for x in words) if len(w) >= 3 and w not in STOP_WORDS and w not in FILLERS and not re.search("[-/0-9]", w)]
    pairs: list[str] = []
    for a, b in zip(clean, clean[1:], strict=False):
        if a not in VERBS and b not in VERBS and (len(a) >= 4 or len(b) >= 4):
            put(pairs, a[:1].upper() + a[1:] + b[:1].upper() + b[1:], f"{a}_{b}")
    out.components = first + sorted(single, key=len, reverse=True) + pairs
    return out


def path_terms(task: str, most: int = 5) -> list[str]:
    """The longest words of a task that may name a folder, and the parts of compound ones."""
    out: dict[str, None] = {}
    for word in (w.strip(EDGES + "<>") for w in task.split()):
        low = word.lower()
        if len(low) < 4 or low in PATH_STOPS or re.search(r"[=/<>{}\[\]()@#$%^&*+]", low) or re.fullmatch("[0-9]+", low):
            continue
        out.setdefault(low)
        parts = word.split("_") if "_" in word else re.split("(?<=[a-z])(?=[A-Z])", word) if mixed(word) else []
        for p in (x.lower() for x in parts):
            if len(p) >= 4 and p not in PATH_STOPS:
                out.setdefault(p)
    return sorted(out, key=len, reverse=True)[:most]


def decomposed(words: list[str]) -> list[tuple[str, str]]:
    """(field, term): parts of compounds onto the symbol's name, of dotted ones only of the last two; other words onto all."""
    out: dict[tuple[str, str], None] = {}
    for word in words:
        if not is_compound(word):
            if len(word) >= 3:
                out.setdefault(("", word.lower()))
            continue
        pieces = [s for s in word.split(".")[-2:] if not (s.startswith("__") and s.endswith("__"))] if "." in word else [word]
        for part in (p.lower() for s in pieces for p in identifier_parts(s)):
            if len(part) >= 3:
                out.setdefault(("symbol_name", part))
    return list(out)


def expanded(words: list[str], thesaurus: dict[str, list[str]], most: int = 10) -> list[str]:
    """Related words, of which none was asked for already."""
    out: dict[str, None] = {}
    for word in words:
        for other in thesaurus.get(word.lower(), ()):
            if other not in words and len(out) < most:
                out.setdefault(other)
    return list(out)


def text_query(k: Keywords, paths: list[str], more: list[str] = (), split: bool = False) -> list[tuple[str, str, str]]:
    """(kind, field, text) clauses, any of which may match: compounds as phrases of the symbol's name (or, with split, their
    parts), words, neighbouring components as phrases, folders as prefixes, and related words."""
    words = k.primary or k.components
    if split:
        out = [("term", f, t) for f, t in decomposed(words)]
    else:
        out = [("phrase", "symbol_name", w) if is_compound(w) else ("term", "", w) for w in words]
    for a, b in zip(k.components[:5], k.components[1:6], strict=False):
        if len(a) >= 3 and len(b) >= 3:
            out.append(("phrase", "", f"{a} {b}"))
    out += [("prefix", "file_path", p) for p in paths if len(p) >= 4]
    return list(dict.fromkeys(out + [("term", "", w) for w in more]))


def equivalents(task: str, classes: list[dict], language: str = "") -> list[dict]:
    """Classes (concept, phrases, targets, weight, lang) with a phrase in the task, scoped by language, and their hits."""
    low = task.lower()
    out = []
    for c in classes:
        hits = [p for p in c["phrases"] if p.lower() in low]
        if hits and (not c.get("lang") or not language or c["lang"] == language):
            out.append({**c, "hits": hits, "strong": len(hits) > 1 or " " in hits[0]})
    return out


def with_verbs(phrases: list[str], verbs: list[str]) -> list[str]:
    """Phrases and, for those that begin with no verb, each verb ahead of them."""
    return phrases + [f"{v} {p}" for p in phrases if not any(p.startswith(v) and len(p) > len(v) for v in verbs) for v in verbs]


# Tools and the words of a task that ask for them, and words that ask for nothing.
TOOL_WORDS = [
    ("test_scope", ["test", "affected", "scope"]),
    ("context_for_files", ["changed", "files", "diff", "modified"]),
    ("blast_radius", ["blast", "radius", "impact", "callers"]),
    ("flow_between", ["flow", "path", "between", "reach"]),
    ("communities", ["community", "cluster", "module", "group"]),
    ("feedback", ["feedback", "useful", "report"]),
    ("index_repo", ["index", "reindex"]),
    ("stale_edges", ["stale", "dead", "unused"]),
    ("semantic_diff", ["diff", "snapshot", "compare"]),
    ("context_for_task", ["context", "task", "relevant"]),
    ("trace_dataflow", ["dataflow", "callees", "downstream"]),
    ("context_for_pr", ["pr", "pull request", "review"]),
]


def plan(task: str, rules: list[tuple[str, list[str]]] = TOOL_WORDS, most: int = 4) -> list[str]:
    """Tools whose words the task has most of, in order of the rules where equal; the general one if none."""
    low = task.lower()
    words = set(re.findall(r"[^\W_]{2,}", low))
    score = [sum((w in low) if " " in w else (w in words) for w in asked) for _, asked in rules]
    best = sorted((k for k in range(len(rules)) if score[k]), key=lambda k: -score[k])
    return list(dict.fromkeys(rules[k][0] for k in best))[:most] or ["context_for_task"]


def identifiers(text: str) -> list[str]:
    """Identifiers of three letters or more in free text, each once."""
    return list(dict.fromkeys(x for x in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text) if len(x) >= 3))
