"""Evidence: digests of line ranges, references to them, and whether they still hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK = 64


def digest(lines: Column) -> Column:
    """SHA-256 of lines without their ends, joined by line feeds."""
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"[\r\n]+$", "")), "\n").cast("binary"), 256)


def ref_id(source: Column, start: Column, end: Column, kind: Column, sha: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, start.cast("string"), end.cast("string"), kind, sha).cast("binary"), 256), 1, 12)


def citable(line_no: Column, next_start: Column, context: int = 50, total: Column | None = None) -> Column:
    """Whether an entry's lines are still within the window that is kept while reading."""
    end = F.coalesce(next_start, (total if total is not None else line_no) + 1)
    return line_no >= end - (context + SLACK)


def _joined(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines of ranges (source, start_line, end_line and more), by an equi-join on blocks of line numbers."""
    size = 256
    a = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / size), F.floor(F.col("end_line") / size))))
    b = lines.select("source", "file_line_no", "raw", F.floor(F.col("file_line_no") / size).alias("block"))
    return a.join(b, ["source", "block"]).filter(F.col("file_line_no").between(F.col("start_line"), F.col("end_line"))).drop("block")


def refs(lines: DataFrame, ranges: DataFrame, kind: str = "entry") -> DataFrame:
    """References to ranges (key, source, start_line, end_line): with n_lines, sha256 and ref_id."""
    held = _joined(lines, ranges).groupBy("key", "source", "start_line", "end_line").agg(F.array_sort(F.collect_list(F.struct("file_line_no", "raw"))).alias("x"))
    out = held.select("key", "source", "start_line", "end_line", F.size("x").cast("long").alias("n_lines"), digest(F.transform("x", lambda x: x["raw"])).alias("sha256"))
    return out.withColumn("ref_id", ref_id(F.col("source"), F.col("start_line"), F.col("end_line"), F.lit(kind), F.col("sha256")))


def split_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """key, source, start_line, end_line: ranges (key, first, last) of line_no over a run's files, as one range for each file they
    touch.  A range of which any line is missing gives none."""
    size = 256
    a = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))))
    b = lines.select("file_seq", "source", "file_line_no", "line_no", F.floor(F.col("line_no") / size).alias("block"))
    held = a.join(b, "block").filter(F.col("line_no").between(F.col("first"), F.col("last")))
    parts = held.groupBy("key", "first", "last", "file_seq", "source").agg(F.min("file_line_no").alias("start_line"), F.max("file_line_no").alias("end_line"), F.count("*").alias("n"))
    whole = parts.groupBy("key", "first", "last").agg(F.sum("n").alias("found")).filter("found = last - first + 1")
    return parts.join(whole, ["key", "first", "last"]).select("key", "source", "start_line", "end_line")


def out_of_file(clusters: DataFrame, lines: DataFrame) -> DataFrame:
    """Clusters (source, first_line, last_line: as shown in a report) whose lines are not in their file: with file_lines.  A source that is not there is not judged."""
    sizes = lines.groupBy("source").agg(F.max("file_line_no").alias("file_lines"))
    wrong = (F.col("first_line") < 1) | (F.col("last_line") < F.col("first_line")) | (F.col("last_line") > F.col("file_lines"))
    told = (F.col("first_line") > 0) | (F.col("last_line") > 0)
    return clusters.join(sizes, "source").filter(told & wrong)


def verify(references: DataFrame, lines: DataFrame) -> DataFrame:
    """references (ref_id, source, start_line, end_line, sha256) with status, against the lines as they are now."""
    there = lines.groupBy("source").agg(F.max("file_line_no").alias("size"))
    own = references.select(F.col("ref_id").alias("key"), "source", "start_line", "end_line")
    now = refs(lines, own).select(F.col("key").alias("ref_id"), F.col("sha256").alias("now"), F.col("n_lines").alias("found"))
    joined = references.join(there, "source", "left").join(now, "ref_id", "left")
    status = (
        F.when(F.coalesce(F.col("source"), F.lit("")).isin("", "<text>"), "NO_SOURCE")
        .when(F.col("size").isNull(), "MISSING_SOURCE")
        .when((F.col("end_line") > F.col("size")) | (F.col("start_line") < 1), "OUT_OF_RANGE")
        .when(F.col("now") == F.col("sha256"), "MATCH")
        .otherwise("MISMATCH")
    )
    return joined.select("ref_id", "source", "start_line", "end_line", status.alias("status"))


def verdict(checked: DataFrame) -> DataFrame:
    """One row: counts by status, and the verdict over all of them."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    by = checked.agg(F.count("*").alias("n"), is_("MATCH").alias("matched"), is_("MISMATCH", "OUT_OF_RANGE").alias("broken"), is_("MISSING_SOURCE", "NO_SOURCE", "UNREADABLE").alias("unknown"))
    return by.withColumn("verdict", F.when(F.col("n") == 0, "NO_EVIDENCE").when(F.col("broken") > 0, "TAMPERED").when(F.col("unknown") > 0, "UNVERIFIABLE").otherwise("VERIFIED"))


def context(lines: DataFrame, samples: DataFrame, n: int = 50) -> DataFrame:
    """key, side, line_no, text around samples (key, line_no, next_start): up to n lines before, and from the next entry on."""
    low = F.when(F.col("next_start").isNull(), F.col("line_no") - n).otherwise(F.greatest(F.col("line_no") - n, F.col("next_start") - (n + SLACK)))
    before = samples.select("key", F.lit("before").alias("side"), F.greatest(low, F.lit(1)).alias("lo"), (F.col("line_no") - 1).alias("hi"))
    after = samples.filter("next_start IS NOT NULL").select("key", F.lit("after").alias("side"), F.col("next_start").alias("lo"), (F.col("next_start") + n - 1).alias("hi"))
    size = 256
    ranges = before.unionByName(after).filter("lo <= hi").withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    held = lines.select("line_no", "text", F.floor(F.col("line_no") / size).alias("block"))
    return ranges.join(held, "block").filter(F.col("line_no").between(F.col("lo"), F.col("hi"))).select("key", "side", "line_no", "text")


def fingerprint(clusters: DataFrame) -> DataFrame:
    """One row: a digest of what was concluded, whatever the paths and the order of rows."""
    row = F.to_json(F.struct("level", "template", "count", "first_line", "last_line", "confidence"))
    return clusters.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n").cast("binary"), 256).alias("result_sha256"))
