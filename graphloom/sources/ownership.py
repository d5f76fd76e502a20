"""CODEOWNERS files as rules, and git's porcelain blame and diff output as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.predicates import owners_regex

#: Where a repository may keep its file, first one first. Fixed values.
PLACES = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS")
RULES = "line int, pattern string, regex string, owners array<string>"


def rules_frame(spark: SparkSession, rules: list[tuple[str, list[str]]]) -> DataFrame:
    return spark.createDataFrame([(k, p, owners_regex(p), o) for k, (p, o) in enumerate(rules)], RULES)


def parse_codeowners(text: str) -> list[tuple[str, list[str]]]:
    """(pattern, owners) of each line in order; blanks, comments and lines without owners are passed over."""
    rows = (line.split() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#"))
    return [(words[0], words[1:]) for words in rows if len(words) > 1]


def read_codeowners(spark: SparkSession, path: str) -> DataFrame:
    """The rules of one file (a repository has one, of some kilobytes), by Spark's readers."""
    text = spark.read.text(path, wholetext=True).first()
    return rules_frame(spark, parse_codeowners(text[0] if text else ""))


def blame(lines: DataFrame) -> DataFrame:
    """path, line, author and author_time from porcelain blame output: lines (path, no, text) in order of no.

    A commit's author stands only at its first mention in a file; later ones look it up.
    """
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    rows = lines.withColumns({"commit": F.regexp_extract("text", head, 1), "line": F.expr(r"try_cast(regexp_extract(text, '^[0-9a-f]{40} [0-9]+ ([0-9]+)', 1) as int)")})
    from pyspark.sql.window import Window

    so_far = Window.partitionBy("path").orderBy("no")
    rows = rows.withColumn("of", F.last(F.when(F.col("commit") != "", F.col("commit")), True).over(so_far))
    author = rows.filter(F.col("text").startswith("author ")).select("path", "of", F.expr("substring(text, 8)").alias("author"))
    time = rows.filter(F.col("text").startswith("author-time ")).select("path", "of", F.expr("try_cast(substring(text, 13) as long)").alias("author_time"))
    heads = rows.filter("commit <> ''").select("path", "line", F.col("commit").alias("of"))
    keys = ["path", "of"]
    return heads.join(author.dropDuplicates(keys), keys, "left").join(time.dropDuplicates(keys), keys, "left").select("path", "line", "author", "author_time")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, content_hash): added, deleted or changed. A rename is both of the first
    two; against an empty old listing all are added."""
    j = old.select("path", F.col("content_hash").alias("a")).join(new.select("path", F.col("content_hash").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return j.select("path", change.alias("change")).filter("change is not null")


def symbol_authors(symbols: DataFrame, blamed: DataFrame) -> DataFrame:
    """path, name and author: who wrote most lines from a symbol's own to the next symbol's, ties to the lesser name.

    symbols: path, name, line. Each blamed line belongs to the last symbol that begins at or above it, so both are
    laid in one order a file, and no ranges are joined.
    """
    from pyspark.sql.window import Window

    marks = symbols.select("path", "line", F.struct("line", "name").alias("of"), F.lit(None).cast("string").alias("author"))
    both = marks.unionByName(blamed.select("path", "line", F.lit(None).cast(marks.schema["of"].dataType).alias("of"), "author"))
    order = Window.partitionBy("path").orderBy("line", F.col("author").isNotNull(), "of")
    owner = both.withColumn("own", F.last("of", True).over(order)).filter("author is not null and own is not null")
    votes = owner.groupBy("path", F.col("own.name").alias("name"), "author").agg(F.count("*").alias("n"))
    return votes.groupBy("path", "name").agg(F.min_by("author", F.struct(-F.col("n"), "author")).alias("author"))
