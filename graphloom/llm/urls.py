"""URL filters: rules by host and path, and for all other urls a tree of path templates judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Fixed values: (verdict, host, path). A rule fits its host and all subdomains if the path starts with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Levels of the tree; deeper segments are one wildcard tail. A node's children become a wildcard if they are many
#: and mostly seen once.
LEVELS, MANY, REPEATED = 4, 12, 3.0
#: Weight of the parent's purity in a child's, the purity from which a template is rejected, and the z up to which two
#: branches count as alike.
PRIOR, REJECT, ALIKE = 4.0, 0.6, 2.0
#: The purity of a host of which nothing is known: four bad labels and no other ones reject it.
BASE = 0.25
#: A segment that reads like one of the tree's own branches is written with `=` ahead.
OWN = r"^(\*|\*\*|\+|=.*)$"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as host + path) and its verdict; nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> tuple[Column, Column]:
    """A path's first LEVELS segments, padded with empty ones and joined by `/`, those with a digit as `*`; and `/**` if it
    has more of them."""
    segs = F.filter(F.split(path, "/"), lambda x: x != "")
    name = lambda x: F.when(x.rlike("[0-9]"), "*").when(x.rlike(OWN), F.concat(F.lit("="), x)).otherwise(x)
    shape = F.concat_ws("/", F.transform(F.slice(F.concat(segs, F.array_repeat(F.lit(""), LEVELS)), 1, LEVELS), name))
    return shape, F.when(F.size(segs) > LEVELS, "/**").otherwise("")


def _purity(bad: Column, labelled: Column, prior: Column) -> Column:
    return (bad + PRIOR * prior) / (labelled + PRIOR)


def grow(nodes: DataFrame) -> DataFrame:
    """host, shape, deep, template and purity of shapes (host, shape, deep, n, bad, labelled).

    From a host's root on, each level looks at the children of every branch: segments, by how often they are seen and how
    many of their labels are bad. If they are many and mostly rare they all become the wildcard `*`. Else those whose share
    of bad labels can't be told from their parent's (z up to ALIKE) are merged into `+`, and so are those without any label:
    nothing sets them apart. A branch's purity is its share of bad labels with its parent's purity as PRIOR labels
    more; where it holds all of the parent's labels it is the parent's, since the same labels tell nothing new. A host's
    own parent is BASE.
    """
    hosts = nodes.groupBy("host").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
    hosts = hosts.select("host", "all_bad", "all_labelled", _purity(F.col("all_bad"), F.col("all_labelled"), F.lit(BASE)).alias("purity"))
    tree = common.cut(nodes.join(hosts, "host").withColumn("template", F.lit("")), "tree")
    for level in range(LEVELS):
        seg = F.split("shape", "/")[level]
        at = ["host", "template"]
        child = tree.groupBy(*at, seg.alias("seg")).agg(F.sum("n").alias("sn"), F.sum("bad").alias("sb"), F.sum("labelled").alias("sl"), F.first("all_bad").alias("pb"), F.first("all_labelled").alias("pl"))
        parent = child.groupBy(*at).agg(F.count("*").alias("kinds"), F.sum("sn").alias("pn"))
        rate = F.try_divide(F.col("pb"), F.col("pl"))
        z = F.abs(F.try_divide(F.col("sb"), F.col("sl")) - rate) * F.sqrt(F.try_divide(F.col("sl"), F.greatest(rate * (1 - rate), F.lit(1e-4))))
        branch = (
            F.when(F.col("seg") == "", "")
            .when((F.col("kinds") >= MANY) & (F.col("pn") < REPEATED * F.col("kinds")), "/*")
            .when((F.col("kinds") > 1) & ((F.col("sl") == 0) | (z <= ALIKE)), "/+")
            .otherwise(F.concat(F.lit("/"), F.col("seg")))
        )
        named = common.cut(child.join(parent, at).select(*at, "seg", branch.alias("branch")), "branches")
        tree = tree.withColumn("seg", seg).join(named, [*at, "seg"]).drop("seg")
        tree = tree.withColumns({"of": F.col("template"), "template": F.concat("template", "branch")}).drop("branch")
        own = tree.groupBy("host", "of", "template").agg(F.sum("bad").alias("tb"), F.sum("labelled").alias("tl"))
        tree = tree.join(own, ["host", "of", "template"])
        purity = F.when(F.col("tl") == F.col("all_labelled"), F.col("purity")).otherwise(_purity(F.col("tb"), F.col("tl"), F.col("purity")))
        tree = common.cut(tree.select("host", "shape", "deep", "n", "bad", "labelled", "template", F.col("tb").alias("all_bad"), F.col("tl").alias("all_labelled"), purity.alias("purity")), "tree")
    return tree.select("host", "shape", "deep", "n", F.concat("template", "deep").alias("template"), F.round("purity", 6).alias("purity"))


def judge(pages: DataFrame, rules=RULES, learn: Column | None = None) -> DataFrame:
    """pages' page_id and url with host, path, rule, verdict, template and purity.

    A url takes the verdict of the longest rule that fits it. Others are judged by their template in their host's tree
    (see grow), whose labels are what rules say of the host's other urls: it is blocked if the template's purity, as the
    share of blocked labels, is REJECT or more. Null urls, and those without `://`, have empty parts and are allowed;
    repeated rows each count and are each judged; an empty table gives no rows. With `learn`, a condition on page_id, url,
    host and path, only rows that meet it are labels and take their rule's verdict: the others show what the tree says.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    shape, deep = shape_of(F.col("path"))
    said = verdict if learn is None else F.when(learn, verdict)
    rows = rows.withColumns({"rule": name, "said": said, "shape": shape, "deep": deep})
    # counts by distinct shape first: what follows moves shapes and not pages
    nodes = rows.groupBy("host", "shape", "deep").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "block").alias("bad"), F.count("said").alias("labelled"))
    marks = common.cut(grow(common.cut(nodes, "shapes")), "marks")
    found = common.join_hot(rows, marks, ["host", "shape", "deep"], "n")
    own = F.when((F.col("purity") >= REJECT) & (F.col("host") != ""), "block").otherwise("allow")
    return found.select("page_id", "url", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "template", "purity")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages")).drop("url")


def _sql() -> str:
    """The same by DuckDB: rules, shapes, and a level of the tree after the other."""
    rule, said = "NULL", "NULL"
    for what, h, p in sorted(RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, said = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {said} END"
    name = "CASE WHEN regexp_matches(x, '[0-9]') THEN '*' WHEN regexp_matches(x, '^([*]|[*][*]|[+]|=.*)$', 's') THEN '=' || x ELSE x END"
    items = [
        "u AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://(.*)$', 1, 's') ELSE '' END AS rest FROM pages)",
        "h AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"j AS (SELECT page_id, r, coalesce(host, '') AS host, coalesce(path, '') AS path FROM h), k AS (SELECT *, {rule} AS rule, {said} AS said, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM j)",
        f"w AS (SELECT page_id, r, host, path, rule, said, list_transform(list_concat(segs, ['', '', '', ''])[1:{LEVELS}], lambda x: {name}) AS shape, CASE WHEN len(segs) > {LEVELS} THEN '/**' ELSE '' END AS deep FROM k)",
        "n AS (SELECT host, shape, deep, count(*) AS n, count(*) FILTER (said = 'block') AS bad, count(said) AS labelled FROM w GROUP BY ALL)",
        f"ho AS (SELECT host, sum(bad) AS pb, sum(labelled) AS pl, (sum(bad) + {PRIOR}e0 * {BASE}e0) / (sum(labelled) + {PRIOR}e0) AS purity FROM n GROUP BY 1)",
        "t0 AS (SELECT host, shape, deep, n, bad, labelled, '' AS template, pb, pl, purity FROM n JOIN ho USING (host))",
    ]
    for k in range(LEVELS):
        rate = "(CAST(pb AS DOUBLE) / nullif(pl, 0))"
        z = f"abs(CAST(sb AS DOUBLE) / nullif(sl, 0) - {rate}) * sqrt(sl / greatest({rate} * (1 - {rate}), 1e-4))"
        items += [
            f"c{k} AS (SELECT host, template, shape[{k + 1}] AS seg, sum(n) AS sn, sum(bad) AS sb, sum(labelled) AS sl, any_value(pb) AS pb, any_value(pl) AS pl FROM t{k} GROUP BY ALL)",
            f"p{k} AS (SELECT *, count(*) OVER (PARTITION BY host, template) AS kinds, sum(sn) OVER (PARTITION BY host, template) AS pn FROM c{k})",
            f"b{k} AS (SELECT host, template, seg, CASE WHEN seg = '' THEN '' WHEN kinds >= {MANY} AND pn < {REPEATED} * kinds THEN '/*' WHEN kinds > 1 AND (sl = 0 OR {z} <= {ALIKE}) THEN '/+' ELSE '/' || seg END AS branch FROM p{k})",
            f"d{k} AS (SELECT t.*, t.template || branch AS new FROM t{k} t JOIN b{k} b ON b.host = t.host AND b.template = t.template AND b.seg = t.shape[{k + 1}])",
            f"o{k} AS (SELECT host, template, new, sum(bad) AS tb, sum(labelled) AS tl FROM d{k} GROUP BY ALL)",
            f"t{k + 1} AS (SELECT d.host, shape, deep, n, bad, labelled, d.new AS template, tb AS pb, tl AS pl, CASE WHEN tl = pl THEN purity ELSE (tb + {PRIOR}e0 * purity) / (tl + {PRIOR}e0) END AS purity FROM d{k} d JOIN o{k} o ON o.host = d.host AND o.template = d.template AND o.new = d.new)",
        ]
    last = f"t{LEVELS}"
    return f"WITH {', '.join(items)} SELECT page_id, w.host, path, rule, coalesce(said, CASE WHEN round(purity, 6) >= {REJECT} AND w.host <> '' THEN 'block' ELSE 'allow' END) AS verdict, template || w.deep AS template, round(purity, 6) AS purity FROM w JOIN {last} t ON t.host = w.host AND t.shape = w.shape AND t.deep = w.deep"


OP2_SQL = _sql()
