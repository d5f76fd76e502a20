"""Trace spans, in batches or as a stream, into runtime edges; what follows from sessions and what they used.

A stream's rows carry their own time. Where the reference takes the time of arrival, this takes the span's, so that a replay
gives the same rows; `windows` adds a watermark for late ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import identity

SPAN = "trace_id string, span_id string, parent_span_id string, service_name string, operation_name string, peer_service string, attributes map<string,string>, start_time timestamp, duration_ns long"
EDGE = "edge_hash string, source_hash string, target_hash string, edge_type string, confidence double, provenance string, observation_count long, last_observed long"


def provenance(trace_ids: Column) -> Column:
    """`otel_trace` with the first five trace ids as JSON; bare without any."""
    return F.when(F.size(trace_ids) > 0, F.concat(F.lit("otel_trace:"), F.to_json(F.struct(F.slice(trace_ids, 1, 5).alias("trace_ids"))))).otherwise("otel_trace")


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("attributes"), F.lit(name)), F.lit(""))


def route_key(spans: DataFrame) -> DataFrame:
    """spans with mapping_type and route_pattern: `METHOD /route`, `service.method`, or the operation's name."""
    http = (_attr("http.method") != "") & (_attr("http.route") != "")
    rpc = (_attr("rpc.service") != "") & (_attr("rpc.method") != "")
    kind = F.when(http, "http_route").when(rpc, "grpc_method").otherwise("unknown")
    key = F.when(http, F.concat_ws(" ", _attr("http.method"), _attr("http.route"))).when(rpc, F.concat_ws(".", _attr("rpc.service"), _attr("rpc.method"))).otherwise(F.col("operation_name"))
    return spans.withColumns({"mapping_type": kind, "route_pattern": key})


def resolve(spans: DataFrame, routes: DataFrame) -> DataFrame:
    """trace_id, start_time and the edge of each span: from its service onto the peer's (or its own) route's symbol with
    confidence 1, or onto an unresolved endpoint with 0.3. routes: service_name, route_pattern, mapping_type, node_hash."""
    rows = route_key(spans).withColumn("to", F.coalesce(F.nullif("peer_service", F.lit("")), "service_name"))
    known = routes.select(F.col("service_name").alias("to"), "route_pattern", "mapping_type", "node_hash")
    found = rows.join(known, ["to", "route_pattern", "mapping_type"], "left")
    made = identity.node_hash(F.col("to"), F.lit("UNRESOLVED"), F.col("route_pattern"), F.lit("runtime_endpoint"))
    source = identity.node_hash(F.col("service_name"), F.lit(""), F.col("service_name"), F.lit("service"))
    out = found.select("trace_id", "start_time", source.alias("source_hash"), F.coalesce("node_hash", made).alias("target_hash"), identity.edge_type_of(F.col("attributes")).alias("edge_type"), F.when(F.col("node_hash").isNull(), 0.3).otherwise(1.0).alias("sure"))
    return out.withColumn("edge_hash", identity.edge_hash(F.col("source_hash"), F.col("target_hash"), F.col("edge_type"), F.lit("otel_trace")))


def observe(resolved: DataFrame) -> DataFrame:
    """Batch or stream (update mode): a row an edge with count, last sight, first trace and confidence by count; an edge seen
    once is as sure as its resolver at most."""
    at = F.unix_seconds(F.col("start_time").cast("timestamp"))
    g = resolved.groupBy("edge_hash", "source_hash", "target_hash", "edge_type").agg(F.count("*").alias("observation_count"), F.max(at).alias("last_observed"), F.min("sure").alias("sure"), F.min_by("trace_id", F.struct(at, "trace_id")).alias("trace"))
    by_count = identity.confidence_of_count(F.col("observation_count"))
    sure = F.when(F.col("observation_count") == 1, F.least(by_count, "sure")).otherwise(by_count)
    return g.select("edge_hash", "source_hash", "target_hash", "edge_type", sure.alias("confidence"), provenance(F.array("trace")).alias("provenance"), "observation_count", "last_observed")


def merge(base: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, events): base with a batch's observations added; known edges keep their provenance and take their confidence
    from the new count, new ones come with an `added` event of no snapshot."""
    s = seen.select("edge_hash", F.struct(*[c for c in seen.columns if c != "edge_hash"]).alias("s"))
    b = base.select("edge_hash", F.struct(*[c for c in base.columns if c != "edge_hash"]).alias("b"))
    j = b.join(s, "edge_hash", "full")
    n = F.coalesce("b.observation_count", F.lit(0)) + F.coalesce("s.observation_count", F.lit(0))
    pick = lambda c: F.coalesce(f"b.{c}", f"s.{c}").alias(c)
    again = F.col("b").isNotNull() & F.col("s").isNotNull()
    confidence = F.when(again, identity.confidence_of_count(n)).otherwise(F.coalesce("b.confidence", "s.confidence"))
    edges = j.select("edge_hash", pick("source_hash"), pick("target_hash"), pick("edge_type"), confidence.alias("confidence"), pick("provenance"), n.cast("long").alias("observation_count"), F.greatest("b.last_observed", "s.last_observed").alias("last_observed"))
    new = seen.join(base.select("edge_hash"), "edge_hash", "left_anti")
    return edges, new.select("edge_hash", F.lit("added").alias("event_type"), F.lit(None).cast("string").alias("snapshot_hash"), F.col("last_observed").alias("timestamp"))


def windows(resolved: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts by window of event time, for append mode: rows later than `late` are dropped by the watermark."""
    return resolved.withWatermark("start_time", late).groupBy(F.window("start_time", size), "edge_hash").agg(F.count("*").alias("n"))


def start(spans: DataFrame, routes: DataFrame, store, checkpoint: str, seconds: int = 10, once: bool = False, after: Callable[[int], None] | None = None):
    """Run a stream of spans into a store's edges and events: a micro-batch every some seconds (its size is the source's
    maxFilesPerTrigger), each a new version of the tables; `after` is told the batch, for caches to go. A batch that ran
    already is passed over, since versions carry no batch number: the events' ids do."""

    def put(batch: DataFrame, number: int) -> None:
        events = store.read("edge_events")
        if not events.filter(F.col("source_commit") == f"batch {number}").isEmpty():
            return
        base = store.read("edges")
        runtime = base.filter(F.col("provenance").like("otel_%"))
        edges, new = merge(runtime.select(*[x.split()[0] for x in EDGE.split(", ")]), observe(resolve(batch, routes)))
        known = base.select("edge_hash", "callsite_line", "callsite_col", "callsite_file", "indexed_at")
        rest = base.join(edges.select("edge_hash"), "edge_hash", "left_anti")
        store.write("edges", rest.unionByName(edges.join(known, "edge_hash", "left").select(*base.columns)))
        mark = new.limit(0).unionByName(new).select("edge_hash", "event_type", "snapshot_hash", "timestamp", F.lit(f"batch {number}").alias("source_commit"))
        store.write("edge_events", events.unionByName(mark, allowMissingColumns=True))
        if after is not None:
            after(number)

    writer = spans.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


# ---------------------------------------------------------------- sessions


def implicit_feedback(returned: DataFrame, used: DataFrame, minutes: int = 10) -> DataFrame:
    """Symbols that were returned (session_id, symbol, at) and named within `minutes` (used: session_id, symbol, at) are
    useful, others not. The next use of each is looked up along one order, so no ranges are joined."""
    a = returned.select("session_id", "symbol", "at", F.lit(None).cast("long").alias("use"), F.lit(True).alias("asked"))
    b = used.select("session_id", "symbol", "at", F.col("at").cast("long").alias("use"), F.lit(False).alias("asked"))
    order = Window.partitionBy("session_id", "symbol").orderBy("at", F.col("asked").desc()).rowsBetween(0, Window.unboundedFollowing)
    both = a.unionByName(b).withColumn("next", F.first("use", True).over(order)).filter("asked")
    good = F.coalesce(F.col("next") <= F.col("at") + 60 * minutes, F.lit(False)).cast("int")
    return both.groupBy("session_id", "symbol", "at").agg(F.max(good).alias("useful"))


def named(texts: DataFrame) -> DataFrame:
    """session_id, symbol (an identifier of three letters or more, lower-cased) and at, of texts (session_id, text, at)."""
    words = F.array_distinct(F.transform(F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), lambda w: F.length(w) >= 3), F.lower))
    return texts.select("session_id", "at", F.explode(words).alias("symbol"))


def session_boosts(accesses: DataFrame, now: int, last: int = 20, half_life: float = 180.0) -> DataFrame:
    """Decayed counts over the last accesses of each symbol in its session, 2 at most, those of 0.01 or less left out."""
    recent = accesses.withColumn("k", F.row_number().over(Window.partitionBy("session_id", "symbol").orderBy(F.desc("at"), F.desc("id")))).filter(F.col("k") <= last)
    g = recent.groupBy("session_id", "symbol").agg(F.sum(F.exp(F.lit(-0.6931471805599453 / half_life) * (F.lit(now) - F.col("at")))).alias("b"))
    return g.select("session_id", "symbol", F.round(F.least("b", F.lit(2.0)), 6).alias("boost")).filter("boost > 0.01")


class Health:
    """A receiver's state: stopped, connected, failed after several failures in a row; a success mends it."""

    def __init__(self, most_failures: int = 3):
        self.most, self.failures, self.state = most_failures, 0, "stopped"

    def started(self) -> None:
        self.failures, self.state = 0, "connected"

    def stopped(self) -> None:
        self.state = "stopped"

    def report(self, ok: bool) -> str:
        self.failures = 0 if ok else self.failures + 1
        if self.state != "stopped":
            self.state = "failed" if self.failures >= self.most else "connected"
        return self.state
