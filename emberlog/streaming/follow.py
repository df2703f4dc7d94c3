"""Continuous ingestion: lines to entries with the open entry as state, windows over entries, batches into templates.

Arrival order within a source is the order of its line numbers; late data only matter to windowed
counts, which have a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.functions.text import strip
from emberlog.operators import cluster, structured
from emberlog.operators.assemble import classify, describe
from emberlog.operators.rules import RuleSet, load

OPEN = ("start", "line_no", "last_line_no", "raw", "extra", "stack")
STATE = "start long, line_no long, last_line_no long, raw string, extra array<string>, stack array<string>"
CLOSED = f"source string, next_start long, {STATE}"
IDLE_MS = 30_000


def _extend(entry: dict, nos: np.ndarray, texts: list[str], stacks: np.ndarray) -> None:
    """Lines that follow in an entry: from its first stack line on all are stack."""
    if not len(texts):
        return
    k = 0 if entry["start"] == 0 or entry["stack"] else int(np.argmax(stacks)) if stacks.any() else len(texts)
    entry["extra"] += texts[:k]
    entry["stack"] += texts[k:]
    entry["last_line_no"] = int(nos[-1])


def assemble(lines: DataFrame, rule: str | RuleSet | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """Entries of a stream of lines (source, line_no, text), as assemble.entries makes them of a table; line_no counts within a source.

    Each source keeps its open entry as state: an entry comes out when the next one begins, or when its source has been silent
    for idle_ms.  Lines that go on with an entry after that are an entry without a START line.  A null text counts as blank.
    The timeout needs batches without data, so a query that is to end by itself (availableNow) sets
    spark.sql.streaming.noDataMicroBatches.enabled to false; then open entries stay in the state.
    """
    rules = load(rule)
    kept = classify(lines.select("source", "line_no", "text").filter(strip(F.col("text")) != ""), rules).select("source", "line_no", "text", "kind")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(OPEN, state.get)) if state.exists else None
        if held:
            held |= {"extra": list(held["extra"]), "stack": list(held["stack"])}
        out: list[tuple] = []

        def close(ahead: int | None) -> None:
            if held:
                out.append((key[0], ahead, *(held[c] for c in OPEN)))

        if state.hasTimedOut:
            close(None)
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("line_no")
            nos, texts = rows["line_no"].to_numpy(), rows["text"].tolist()
            stacks = rows["kind"].isin(["IND_STACK", "STACK"]).to_numpy()
            heads = np.flatnonzero(rows["kind"].to_numpy() == "START")
            bounds = [0, *heads.tolist(), len(texts)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if k:
                    close(int(nos[a]))
                    held = {"start": int(nos[a]), "line_no": int(nos[a]), "last_line_no": int(nos[a]), "raw": texts[a], "extra": [], "stack": []}
                elif held is None and b:
                    held = {"start": 0, "line_no": int(nos[a]), "last_line_no": int(nos[a]), "raw": texts[a], "extra": [], "stack": []}
                _extend(held, nos[a + (k > 0) : b], texts[a + (k > 0) : b], stacks[a + (k > 0) : b])
            state.update(tuple(held[c] for c in OPEN))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["source", "next_start", *OPEN]).astype({"next_start": "Int64"})

    closed = kept.groupBy("source").applyInPandasWithState(run, CLOSED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    # the first line is judged again here, so that the state need not hold what it says
    told = rules.with_match(structured.with_claim(closed.withColumn("text", F.col("raw"))))
    head = F.when(F.col("start") > 0, F.struct("text", "claim", "m"))
    return describe(told.withColumn("head", head).withColumn("file_line_no", F.col("line_no")).withColumn("file_last_line_no", F.col("last_line_no")), rules, [])


def windowed_counts(entries: DataFrame, size: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Entries by level and tumbling window of their time (column at, a timestamp)."""
    return entries.withWatermark("at", late).groupBy(F.window("at", size), "level").agg(F.count("*").alias("n"))


class TemplateTable:
    """A table of templates that each micro-batch merges its own into; for foreachBatch.

    Every batch writes a new version under its id, so a batch that runs again leaves the same table.
    """

    def __init__(self, path: str):
        self.path = path

    def merge(self, entries: DataFrame, batch_id: int) -> None:
        new = cluster.templates(cluster.with_template(entries))
        if batch_id > 0:
            old = entries.sparkSession.read.parquet(f"{self.path}/v{batch_id - 1}")
            new = new.unionByName(old)
        new.groupBy("level", "template").agg(F.sum("count").alias("count"), F.min("first_line").alias("first_line")).write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
