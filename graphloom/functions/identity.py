"""Content-addressed identity and qualified-name parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts) -> Column:
    """Parts joined by NUL; a null counts as the empty text, so that none is dropped."""
    return F.concat_ws("\0", *(F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))


def node_hash(repo: Column, package: Column, name: Column, kind: Column) -> Column:
    return F.sha2(_joined("node", repo, package, name, kind), 256)


def edge_hash(source: Column, target: Column, kind: Column, provenance: Column) -> Column:
    return F.sha2(_joined("edge", source, target, kind, provenance), 256)


def snapshot_hash(root: Column) -> Column:
    return F.sha2(F.concat(F.lit("snapshot\0").cast("binary"), F.unhex(root)), 256)


def merkle_parent(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("merkle\0").cast("binary"), F.unhex(left), F.unhex(right)), 256)


def repo_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def keyword_cluster(keywords: Column) -> Column:
    """Of a sorted set of keywords; null if there are none."""
    return F.when(F.size(keywords) > 0, F.sha2(F.concat(F.lit("cluster\0"), F.array_join(F.sort_array(keywords), "\0")), 256))


def package_of(qualified: Column) -> Column:
    """After the last `://`, up to the first dot after the last slash; null without either."""
    return F.nullif(F.regexp_extract(qualified, r"^.*://((?:[^/]*/)*[^/.]*)\.", 1), F.lit(""))


def terminal_name(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def parent_name(qualified: Column) -> Column:
    """The qualified name without its last `.part`."""
    return F.regexp_extract(qualified, r"^(.*)\.[^.]*$", 1)


def token_set(text: Column) -> Column:
    """Distinct lower-case words of three letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def confidence_of_count(n: Column) -> Column:
    return F.when(n > 1000, 0.95).when(n >= 100, 0.85).when(n >= 10, 0.7).when(n >= 1, 0.5).otherwise(0.2)


def decayed(confidence: Column, age_days: Column) -> Column:
    return F.when(age_days > 90, 0.0).when(age_days > 30, 0.2).otherwise(confidence)


def token_cost(qualified: Column, kind: Column, signature: Column) -> Column:
    """A quarter of the bytes of the three, at least 1."""
    return F.greatest(F.floor(F.octet_length(F.concat_ws(" ", qualified, kind, signature)) / 4), F.lit(1)).cast("long")


def edge_type_of(attributes: Column) -> Column:
    """The kind of runtime edge that a span's attributes tell."""
    has = lambda k: F.map_contains_key(attributes, k)
    queue = F.coalesce(F.try_element_at(attributes, F.lit("messaging.system")), F.lit("")) != ""
    kind = F.when(has("http.method"), "runtime_calls").when(has("rpc.service"), "runtime_rpc")
    return kind.when(queue & has("messaging.destination"), "runtime_produces").when(queue, "runtime_consumes").otherwise("runtime_calls")


def confidence_bucket(total: Column) -> Column:
    return F.when(total > 20, "high").when(total > 5, "medium").otherwise("low")
