"""Lines with exact numbers: from files, from text columns, from pasted text.

Schema: source, file_seq, file_line_no, line_no, raw, text.  file_line_no counts within a
file, line_no goes on over the files of a run.  Numbers come from sorting within a file
and a running sum of file sizes, never from one global sort.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.text import strip_ansi

#: What str.splitlines() takes for a line end.
LINE_ENDS = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def _numbered(rows: DataFrame) -> DataFrame:
    """rows: source, file_seq, file_line_no, raw."""
    sizes = rows.groupBy("file_seq").agg(F.max("file_line_no").alias("size"))
    before = sizes.select("file_seq", F.coalesce(F.sum("size").over(Window.orderBy("file_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(before, "file_seq").select("source", "file_seq", "file_line_no", (F.col("file_line_no") + F.col("base")).alias("line_no"), "raw", strip_ansi(F.regexp_replace("raw", "\r+$", "")).alias("text"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files in the given order; gzip by extension.  A line's number is its place in its file."""
    frames = []
    for seq, path in enumerate(paths):
        text = spark.read.option("lineSep", "\n").text(path)
        at = Window.partitionBy("file_seq").orderBy("block", "k")
        rows = text.select(F.lit(path).alias("source"), F.lit(seq).alias("file_seq"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("raw"))
        frames.append(rows.withColumn("file_line_no", F.row_number().over(at).cast("long")).drop("block", "k"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return _numbered(out)


def oldest_first(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths of a rotated log in the order of their time of change; those whose time is unknown stay last, in the given order."""

    def changed(path: str) -> float:
        try:
            at = spark.read.format("binaryFile").load(path).agg(F.max(F.unix_micros("modificationTime"))).first()[0]
        except AnalysisException:
            at = None
        return float("inf") if at is None else at

    return sorted(paths, key=changed)


def consecutive(lines: DataFrame) -> DataFrame:
    """Lines of several files with line_no going on from file to file, in the order of file_seq."""
    return _numbered(lines.select("source", "file_seq", "file_line_no", "raw"))


def from_column(df: DataFrame, key: str, text: str, ends: str = "\n") -> DataFrame:
    """Each row's text as a file of its own, in the order of key: source is the key as a string."""
    seq = F.col(key).cast("long")
    rows = df.select(F.col(key).cast("string").alias("source"), seq.alias("file_seq"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), ends)).alias("at", "raw"))
    return rows.select("source", "file_seq", (F.col("at") + 1).cast("long").alias("file_line_no"), (F.col("at") + 1).cast("long").alias("line_no"), "raw", strip_ansi(F.regexp_replace("raw", "\r+$", "")).alias("text"))


def from_text(spark: SparkSession, text: str, source: str = "<text>") -> DataFrame:
    """Pasted text, cut wherever Python's splitlines() cuts."""
    parts = spark.createDataFrame([(source, 0, text)], "source string, file_seq int, body string").select("source", "file_seq", F.posexplode(F.split("body", LINE_ENDS)).alias("at", "raw"), F.length("body").alias("n"))
    last = F.max("at").over(Window.partitionBy("file_seq"))
    rows = parts.withColumn("last", last).filter("NOT (at = last AND raw = '')")
    return _numbered(rows.select("source", "file_seq", (F.col("at") + 1).cast("long").alias("file_line_no"), "raw"))


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of each file, with their own numbers."""
    sizes = lines.groupBy("file_seq").agg(F.max("file_line_no").alias("size"))
    return lines.join(sizes, "file_seq").filter(F.col("file_line_no") > F.col("size") - n).drop("size")


def cap(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines of the run."""
    return lines.filter(F.col("line_no") <= n)


def sample(lines: DataFrame, n: int = 150) -> DataFrame:
    """A third each from the head, the middle and the tail of every file: always the same lines."""
    third = n // 3
    sizes = lines.groupBy("file_seq").agg(F.max("file_line_no").alias("size"))
    no, size = F.col("file_line_no"), F.col("size")
    middle = F.floor((size - third) / 2)
    return lines.join(sizes, "file_seq").filter((size <= n) | (no <= third) | ((no > middle) & (no <= middle + third)) | (no > size - third)).drop("size")


def read_range(lines: DataFrame, source: str, first: int, last: int) -> DataFrame:
    return lines.filter((F.col("source") == source) & F.col("file_line_no").between(first, last)).orderBy("file_line_no")


def raw_chars(lines: DataFrame) -> DataFrame:
    """One row: lines, and characters with their line ends."""
    return lines.agg(F.count("*").alias("n_lines"), F.sum(F.length("raw") + 1).alias("raw_chars"))


def binary_guard(lines: DataFrame) -> DataFrame:
    """Per source: lines with a NUL, and whether the source should be refused as binary."""
    return lines.groupBy("source").agg(F.count_if(F.col("raw").contains("\x00")).alias("nul_lines"), F.count("*").alias("n_lines")).withColumn("refused", F.col("nul_lines") > 0)
