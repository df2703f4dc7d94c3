"""A data source for what Spark's text reader cannot take: zip members, gzip without its extension, mixed encodings.

Each file is one partition, read line by line; a line is decoded as UTF-8 if it can be, else in the
file's own encoding, else as GB18030, else with replacement marks.
"""

from __future__ import annotations

import codecs
import gzip
import io
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
SAMPLE, HEAD = 256 * 1024, 4096
SCHEMA = "source string, file_seq int, file_line_no long, raw string, decode_status string, has_nul boolean"


def detect(sample: bytes) -> str:
    """The encoding of a file by its mark, its NULs, and a vote of its lines."""
    for mark, name in MARKS:
        if sample.startswith(mark):
            return name
    head = sample[:HEAD]
    if head and head.count(0) > len(head) / 4:
        return "utf-16-le" if head[1::2].count(0) >= head[::2].count(0) else "utf-16-be"
    rows = [x for x in sample.split(b"\n")[:-1] or [sample] if any(b > 127 for b in x)]
    good = sum(_decodes(x, "utf-8") for x in rows)
    if not rows or 2 * good >= len(rows):
        return "utf-8"
    return "gb18030" if sum(_decodes(x, "gb18030") for x in rows) > good else "utf-8"


def _decodes(raw: bytes, name: str) -> bool:
    try:
        raw.decode(name)
        return True
    except UnicodeDecodeError:
        return False


def decode(raw: bytes, primary: str) -> tuple[str, str]:
    """(text, status): primary, repaired (another encoding) or undecodable."""
    for name in dict.fromkeys((primary, "utf-8", "gb18030")):
        try:
            return raw.decode(name).removeprefix("﻿"), "primary" if name == primary else "repaired"
        except UnicodeDecodeError:
            continue
    return raw.decode(primary, "replace").removeprefix("﻿"), "undecodable"


def open_any(path: str) -> io.BufferedIOBase:
    """The bytes of a file, unpacked by what they are: the largest member of a zip, gzip, or plain."""
    with open(path, "rb") as f:
        magic = f.read(4)
    if magic[:2] == b"\x1f\x8b":
        return gzip.open(path, "rb")
    if magic == b"PK\x03\x04":
        pack = zipfile.ZipFile(path)
        return pack.open(max((m for m in pack.infolist() if not m.is_dir()), key=lambda m: m.file_size))
    return open(path, "rb")


def read(path: str, encoding: str = "auto") -> Iterator[tuple[int, str, str, bool]]:
    """(number, text, status, has a NUL) of each line."""
    with open_any(path) as f:
        sample = f.read(SAMPLE)
    name = detect(sample) if encoding == "auto" else {"gbk": "gb18030"}.get(encoding, encoding)
    with open_any(path) as f:
        if name.startswith(("utf-16", "utf-32")):
            for k, line in enumerate(io.TextIOWrapper(f, encoding=name, errors="replace", newline="\n"), 1):
                line = line.removesuffix("\n").removeprefix("﻿")
                yield k, line, "primary", "\x00" in line
        else:
            for k, raw in enumerate(f, 1):
                line, status = decode(raw.removesuffix(b"\n"), name)
                yield k, line, status, b"\x00" in raw


class _Part(InputPartition):
    def __init__(self, seq: int, path: str):
        self.seq, self.path = seq, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.encoding = options["paths"].split("\n"), options.get("encoding", "auto")

    def partitions(self) -> list[_Part]:
        return [_Part(k, p) for k, p in enumerate(self.paths)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for k, line, status, nul in read(partition.path, self.encoding):
            yield partition.path, partition.seq, k, line, status, nul


class PackedLog(DataSource):
    """spark.read.format("packedlog").option("paths", newline-joined paths).load()"""

    @classmethod
    def name(cls) -> str:
        return "packedlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_packed(spark, paths: list[str], encoding: str = "auto"):
    """Lines of such files, numbered over the run like any other."""
    from emberlog.sources.lines import _numbered

    spark.dataSource.register(PackedLog)
    rows = spark.read.format("packedlog").option("paths", "\n".join(paths)).option("encoding", encoding).load()
    return _numbered(rows.select("source", "file_seq", "file_line_no", "raw"))


def decode_notes(spark, paths: list[str], encoding: str = "auto"):
    """Per source: lines, repaired, undecodable, with a NUL; and whether it is refused as binary."""
    from pyspark.sql import functions as F

    spark.dataSource.register(PackedLog)
    rows = spark.read.format("packedlog").option("paths", "\n".join(paths)).option("encoding", encoding).load()
    bad = F.count_if(F.col("decode_status") == "undecodable")
    return rows.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if(F.col("decode_status") == "repaired").alias("repaired"), bad.alias("undecodable"), F.count_if("has_nul").alias("nul_lines")).withColumn("refused", (F.col("nul_lines") > 0) | (F.col("undecodable") == F.col("n_lines")))
