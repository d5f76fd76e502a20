"""Exported traces and request logs as spans, from files or streams of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = "struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
#: OTLP as JSON: resources, their scopes, and their spans.
OTLP = f"resourceSpans array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRIBUTES}>>>>>>"
HTTP_LOG = "timestamp timestamp, method string, path string, status_code int, service_name string, client_ip string, duration_ns long"


def text_of(value: Column) -> Column:
    """An attribute's value as text: of what kind it is."""
    double = value["doubleValue"]
    short = F.when(double == F.floor(double), double.cast("long").cast("string")).otherwise(double.cast("string"))
    return F.coalesce(value["stringValue"], value["intValue"], value["boolValue"].cast("string"), short, F.lit(""))


def _map(attributes: Column) -> Column:
    """The last value of each key counts."""
    rows = F.coalesce(attributes, F.array().cast(ATTRIBUTES))
    pairs = F.transform(rows, lambda a: F.struct(a["key"], text_of(a["value"])))
    seen = F.aggregate(pairs, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.map_from_entries(F.array(p))))
    return seen


def spans_of(requests: DataFrame) -> DataFrame:
    """A row for each span of OTLP requests: ids, its resource's service, peer, attributes, start and duration (0 unless the
    end is later). Works on streams."""
    r = requests.select(F.explode("resourceSpans").alias("r")).select(_map(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeSpans").alias("sc"))
    s = r.select("res", F.explode("sc.spans").alias("s")).withColumn("attributes", _map(F.col("s.attributes")))
    begin, end = F.coalesce(F.col("s.startTimeUnixNano").cast("long"), F.lit(0)), F.coalesce(F.col("s.endTimeUnixNano").cast("long"), F.lit(0))
    return s.select(
        F.lower("s.traceId").alias("trace_id"), F.lower("s.spanId").alias("span_id"), F.lower(F.coalesce("s.parentSpanId", F.lit(""))).alias("parent_span_id"),
        F.coalesce(F.try_element_at("res", F.lit("service.name")), F.lit("")).alias("service_name"), F.col("s.name").alias("operation_name"),
        F.coalesce(F.try_element_at("attributes", F.lit("peer.service")), F.lit("")).alias("peer_service"), "attributes",
        F.when(begin > 0, F.timestamp_micros(F.floor(begin / 1000).cast("long"))).alias("start_time"), F.when(end > begin, end - begin).otherwise(0).cast("long").alias("duration_ns"),
    )


def read_otlp(spark: SparkSession, path: str, stream: bool = False, most_files: int = 100) -> DataFrame:
    """Spans of JSON files, a request a line; as a stream some files a micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", most_files) if stream else spark.read
    return spans_of(reader.schema(OTLP).json(path))


def spans_of_logs(logs: DataFrame) -> DataFrame:
    """A span for each logged request: `METHOD path` with its method and route as attributes."""
    name = F.concat_ws(" ", "method", "path")
    attributes = F.create_map(F.lit("http.method"), F.col("method"), F.lit("http.route"), F.col("path"), F.lit("http.status_code"), F.col("status_code").cast("string"))
    empty = F.lit("")
    return logs.select(empty.alias("trace_id"), empty.alias("span_id"), empty.alias("parent_span_id"), "service_name", name.alias("operation_name"), empty.alias("peer_service"), attributes.alias("attributes"), F.col("timestamp").alias("start_time"), "duration_ns")
