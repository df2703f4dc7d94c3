"""Structured lines: JSON objects and logfmt, and which of their fields mean what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field names by meaning, in order of preference.
ALIASES = {
    "level": ("level", "severity", "severity_text", "severitytext", "lvl", "loglevel", "levelname", "level_name", "priority", "loglevel_name", "severitynumber", "log.level", "log.severity"),
    "message": ("message", "msg", "log", "event", "@message", "short_message", "text", "description", "body", "event.original", "event.original_message", "content", "line"),
    "timestamp": ("timestamp", "time", "ts", "@timestamp", "eventtime", "datetime", "date", "asctime", "event_time", "time_unix_nano", "observedtimestamp", "logged_at", "time_stamp"),
    "module": ("service", "service.name", "servicename", "logger", "logger_name", "loggername", "app", "application", "app_name", "module", "component", "source", "service_name", "job", "job_name", "origin", "source_name", "context.source", "name", "host", "hostname"),
    "trace_id": ("trace_id", "traceid", "trace.id", "otel.trace_id", "trace", "traceparent", "trace-id", "x-b3-traceid", "b3.traceid"),
    "request_id": ("request_id", "requestid", "request.id", "correlation_id", "correlationid", "req_id", "reqid", "requestid_internal", "correlation-id", "x-request-id", "x-correlation-id", "session_id", "sessionid"),
    "span_id": ("span_id", "spanid", "span.id", "otel.span_id", "span", "x-b3-spanid", "b3.spanid"),
    "error": ("error", "err", "exception", "exc", "error.message", "stack_trace", "stacktrace", "stack", "error_message", "errmessage", "exc_info", "exception_message"),
    "exception": ("exception.type", "exception_type", "exceptiontype", "exc_type", "exception_name", "error.type", "err.type"),
}
PAIR = r"""([A-Za-z_][\w.\-]*)=("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s]*)"""
DEPTH = 3


def is_logfmt(text: Column) -> Column:
    """Whether the line begins with a pair and has two or more."""
    return text.rlike("^" + PAIR) & (F.regexp_count(text, F.lit(PAIR)) >= 2)


def json_fields(text: Column) -> Column:
    """A JSON object's scalars by dotted, lower-case path, DEPTH levels deep; null for anything else."""
    top = F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}))
    flat = top
    for _ in range(DEPTH - 1):
        inner = F.transform(F.map_entries(flat), lambda e: F.when(F.ltrim(e["value"]).startswith("{"), F.coalesce(F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: F.struct(F.concat_ws(".", e["key"], x["key"]).alias("key"), x["value"].alias("value"))), F.array(e))).otherwise(F.array(e)))
        flat = F.map_from_entries(F.flatten(inner))
    lowered = F.transform(F.map_entries(flat), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    # of names that differ in case only, the first counts
    return _first_of(lowered)


def logfmt_fields(text: Column) -> Column:
    """A logfmt line's values by lower-case key, unquoted; text after the last pair joins the message."""
    x = F.trim(text)
    keys = F.transform(F.regexp_extract_all(x, F.lit(PAIR), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(x, F.lit(PAIR), F.lit(2)), _unquote)
    entries = F.arrays_zip(keys.alias("key"), values.alias("value"))
    last = F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.array_append(F.filter(acc, lambda y: y["key"] != e["key"]), e))
    tail = F.trim(F.element_at(F.split(x, PAIR, -1), -1))
    joined = F.transform(last, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"].isin(*ALIASES["message"]) & (tail != ""), F.concat_ws(" ", e["value"], tail)).otherwise(e["value"]).alias("value")))
    return F.when(is_logfmt(x), F.map_from_entries(joined))


def _unquote(v: Column) -> Column:
    body = F.substring(v, F.lit(2), F.length(v) - 2)
    plain = F.replace(F.replace(F.replace(F.replace(body, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'")), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    return F.when((F.length(v) >= 2) & v.rlike("""^(".*"|'.*')$"""), plain).otherwise(v)


def _first_of(entries: Column) -> Column:
    """A map of entries in which the first of equal keys counts."""
    kept = F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.when(F.exists(acc, lambda y: y["key"] == e["key"]), acc).otherwise(F.array_append(acc, F.struct(e["key"].alias("key"), e["value"].alias("value")))))
    return F.map_from_entries(kept)


def with_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """df with fields (all of a structured line's scalars, else null), and the maps that pick() reads:
    filled (fields that hold something) and tails (those by the last segment of their path)."""
    x = F.col(text)
    out = df.withColumn("fields", F.when(F.ltrim(x).startswith("{"), json_fields(x)).when(x.contains("="), logfmt_fields(x)))
    out = out.withColumn("filled", F.map_filter("fields", lambda _, v: v.isNotNull() & (F.trim(v) != "") & ~F.ltrim(v).startswith("{") & ~F.ltrim(v).startswith("[")))
    ends = F.transform(F.filter(F.map_entries("filled"), lambda e: e["key"].contains(".")), lambda e: F.struct(F.regexp_replace(e["key"], r"^.*\.", "").alias("key"), e["value"].alias("value")))
    return out.withColumn("tails", _first_of(ends))


def pick(meaning: str) -> Column:
    """The first field with this meaning that holds something: by its whole path, else by its last segment."""
    names = F.array(*map(F.lit, ALIASES[meaning]))
    ends = F.array(*(F.lit(n) for n in ALIASES[meaning] if "." not in n))
    found = F.concat(F.transform(names, lambda n: F.try_element_at(F.col("filled"), n)), F.transform(ends, lambda n: F.try_element_at(F.col("tails"), n)))
    return F.try_element_at(F.filter(found, lambda v: v.isNotNull()), F.lit(1))


def with_claim(df: DataFrame, text: str = "text") -> DataFrame:
    """df with claim: what a structured line says (message, level, timestamp, module, ids, error, fields), or null.

    A line counts as structured if it has a message, a level or an error; an error's text stands in for the message.
    """
    out = with_fields(df, text).withColumn("got", F.when(F.col("fields").isNotNull(), F.struct(*(pick(m).alias(m) for m in ALIASES))))
    g = lambda m: F.col(f"got.{m}")
    error = F.when(g("exception").isNotNull() & g("error").isNotNull(), F.concat_ws(": ", g("exception"), g("error"))).otherwise(F.coalesce(g("error"), g("exception")))
    out = out.withColumn("error", error)
    body = F.struct(F.coalesce(g("message"), F.col("error"), F.lit("")).alias("message"), *(g(m).alias(m) for m in ("level", "timestamp", "module", "trace_id", "request_id", "span_id")), F.col("error").alias("error"), F.col("fields").alias("fields"))
    said = g("message").isNotNull() | g("level").isNotNull() | F.col("error").isNotNull()
    return out.withColumn("claim", F.when(F.col("fields").isNotNull() & said, body)).drop("fields", "filled", "tails", "got", "error")
