from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from emberlog.operators import assemble, cluster
from emberlog.sources import lines as source
from emberlog.streaming import follow

KINDS = [
    "2024-03-01 10:00:00 ERROR [a] head", "\tat x.y(Z.java:1)", "  more", "", "Caused by: E: z", "2024-03-01 10:00:01 INFO [b] other",
    'level=warn svc=x msg="db down" tail', '{"level":"error","message":"boom","trace_id":"t1","error":{"message":"bad","type":"E1"}}', "auth - login failed for",
]
SHOWN = ("source", "line_no", "last_line_no", "next_start", "raw", "ts", "level", "module", "message", "message_extra", "stack", "full_message", "correlation_id", "structured", "fields", "pattern")
END = "2024-03-01 11:00:00 INFO [z] end"


def bodies() -> dict[str, list[str]]:
    r = random.Random(11)
    made = {name: [f"{k} {n}" if (k := r.choice(KINDS)) and not k.startswith("{") else k for n in range(size)] for name, size in (("a", 120), ("b", 45), ("c", 1))}
    return {name: ["  before any start", *lines, END] for name, lines in made.items()}


def stream(spark, folder: str, pieces: int):
    """Lines of all sources in so many files, which arrive one a batch."""
    schema = "source string, line_no long, text string"
    for p in range(pieces):
        rows = [(s, n + 1, x) for s, lines in bodies().items() for n, x in enumerate(lines) if n * pieces // len(lines) == p]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


IDLE = 600_000


def run(query, spark) -> None:
    # a state with a timeout asks for batches without data for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = query.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(100)
    finally:
        q.stop()


def shown(df) -> list[str]:
    return sorted(repr(tuple(r)) for r in df.select(*SHOWN).collect())


def batch(spark, name: str, lines: list[str]):
    return assemble.entries(source.from_text(spark, "\n".join(lines), name))


def test_a_stream_of_lines_makes_the_entries_of_a_table(spark, tmp_path):
    lines = stream(spark, f"{tmp_path}/in", 4)
    run(follow.assemble(lines, idle_ms=IDLE).writeStream.format("memory").queryName("entries").option("checkpointLocation", f"{tmp_path}/c"), spark)
    expected = []
    for name, body in bodies().items():
        # the entry that is still open does not come out
        expected += shown(batch(spark, name, body).filter(F.col("raw") != END))
    assert shown(spark.table("entries")) == sorted(expected)


def test_templates_of_batches_add_up(spark, tmp_path):
    lines = stream(spark, f"{tmp_path}/in", 3)
    table = follow.TemplateTable(f"{tmp_path}/t")
    seen = []
    run(follow.assemble(lines, idle_ms=IDLE).writeStream.foreachBatch(lambda df, k: (table.merge(df, k), seen.append(k))[0]).option("checkpointLocation", f"{tmp_path}/c"), spark)
    table.merge(spark.read.parquet(f"{tmp_path}/t/v{max(seen)}").select("level", "template").limit(0).withColumn("full_message", F.lit("")).withColumn("line_no", F.lit(0)), max(seen) + 1)
    whole = None
    for name, body in bodies().items():
        one = batch(spark, name, body).filter(F.col("raw") != END)
        whole = one if whole is None else whole.unionByName(one)
    show = lambda df: sorted(tuple(r) for r in df.select("level", "template", "count", "first_line").collect())
    assert show(spark.read.parquet(f"{tmp_path}/t/v{max(seen) + 1}")) == show(cluster.templates(cluster.with_template(whole)))


def test_windows_count_entries_by_level(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(seconds=s), lv) for s, lv in ((0, "ERROR"), (59, "ERROR"), (60, "INFO"), (61, "INFO"), (200, "ERROR"))]
    spark.createDataFrame(rows, "at timestamp, level string").write.parquet(f"{tmp_path}/in")
    counted = follow.windowed_counts(spark.readStream.schema("at timestamp, level string").parquet(f"{tmp_path}/in"))
    run(counted.writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", f"{tmp_path}/c"), spark)
    got = sorted((r.window.start, r.level, r.n) for r in spark.table("counts").collect())
    minute = lambda k: at + datetime.timedelta(minutes=k)
    assert got == [(minute(0), "ERROR", 2), (minute(1), "INFO", 2), (minute(3), "ERROR", 1)]
