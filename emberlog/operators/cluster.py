"""Clusters: entries by level and template, templates by similarity, and what a cluster knows.

Similarity runs over distinct templates alone.  Within a level, templates come in the order
of their first line; each joins the most similar founder (by difflib's ratio, the smaller template
of equals) or becomes one.  That is sequential by nature, but only over templates; a level's lines never meet in one task.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.text import SUMMARY_CHARS, causal_lines, deepest_cause, mask
from emberlog.sources.shared import cut, spread

TIERS = {"strict": 0.95, "standard": 0.85, "lenient": 0.70}
DETAILED, META, CAUSES, IDS = 200, 2000, 32, 64


def with_template(entries: DataFrame) -> DataFrame:
    return entries.withColumn("template", mask(F.col("full_message")))


def templates(entries: DataFrame) -> DataFrame:
    """level, template, count, first_line: the exact clusters."""
    return entries.groupBy("level", "template").agg(F.count("*").alias("count"), F.min("line_no").alias("first_line"))


class Known:
    """The founders so far of a level.  Counts of characters (modulo BINS) bound difflib's ratio from above, so most founders
    are ruled out together, and the others are compared from the highest bound down until none can be better."""

    BINS = 128

    def __init__(self, threshold: float):
        self.threshold, self.names = threshold, []
        self.sizes, self.counts = np.zeros(64, np.int64), np.zeros((64, self.BINS), np.int32)

    def _count(self, name: str) -> np.ndarray:
        return np.bincount(np.frombuffer(name.encode("utf-32-le", "surrogatepass"), "<u4") % self.BINS, minlength=self.BINS)

    def add(self, name: str) -> None:
        n = len(self.names)
        if n == len(self.sizes):
            self.sizes, self.counts = np.resize(self.sizes, 2 * n), np.resize(self.counts, (2 * n, self.BINS))
        self.names.append(name)
        self.sizes[n], self.counts[n] = len(name), self._count(name)

    def lead(self, new: str) -> str | None:
        """The founder that a template joins, or None."""
        sizes = self.sizes[: len(self.names)]
        total = np.maximum(sizes + len(new), 1)
        near = np.flatnonzero(2.0 * np.minimum(sizes, len(new)) / total >= self.threshold)
        bound = 2.0 * np.minimum(self.counts[near], self._count(new)).sum(axis=1) / total[near]
        best, score = None, self.threshold
        match = difflib.SequenceMatcher(None)
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < score:
                break
            founder = self.names[near[k]]
            # the second sequence is the one that difflib prepares
            match.set_seqs(new, founder)
            r = match.ratio()
            if r > score or (r == score and (best is None or founder < best)):
                best, score = founder, r
        return best


def founders(found: DataFrame, threshold: float = TIERS["standard"], keys: tuple[str, ...] = ("level",)) -> DataFrame:
    """Each template's founder: keys, template, founder.  found: keys, template, first_line."""
    if threshold <= 0 or threshold > 1:
        return found.select(*keys, "template", F.col("template").alias("founder"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = Known(threshold)
        out = []
        pdf = pdf.sort_values(["first_line", "template"])
        for template in pdf["template"]:
            at = known.lead(template)
            if at is None:
                known.add(template)
            out.append(template if at is None else at)
        result = pdf[[*keys, "template"]].copy()
        result["founder"] = out
        return result

    schema = ", ".join(f"{k} string" for k in keys) + ", template string, founder string"
    return found.select(*keys, "template", "first_line").groupBy(*keys).applyInPandas(run, schema)


def members(entries: DataFrame, threshold: float = TIERS["standard"]) -> DataFrame:
    """entries (with template) with their cluster_id: clusters are numbered by their first line.

    Entries are written once with their templates, as masks are what costs most here; templates are few.
    """
    entries = cut(spread(entries), "templated")
    found = cut(templates(entries), "templates")
    leads = founders(found, threshold)
    if 0 < threshold <= 1:
        leads = cut(leads, "founders")
    first = found.join(leads, ["level", "template"]).groupBy("level", "founder").agg(F.min("first_line").alias("first_line"))
    ids = first.withColumn("cluster_id", F.row_number().over(Window.orderBy("first_line", "level", "founder")))
    numbered = cut(leads.join(ids.select("level", "founder", "cluster_id"), ["level", "founder"]), "clusters")
    return entries.join(numbered, ["level", "template"])


def clusters(held: DataFrame) -> DataFrame:
    """One row a cluster.  held: entries with cluster_id and founder."""
    stacked = F.struct((F.size("stack") == 0).alias("bare"), "line_no")
    shown = F.when(F.col("full_message") != "", F.col("full_message")).otherwise(F.coalesce(F.try_element_at("stack", F.lit(1)), F.lit("")))
    return held.groupBy("cluster_id").agg(
        F.first("level").alias("level"), F.first("founder").alias("template"), F.min_by(F.substring(shown, 1, SUMMARY_CHARS), "line_no").alias("summary"),
        F.coalesce(F.min_by("module", F.when(F.col("module") != "", F.col("line_no"))), F.lit("")).alias("module"), F.count("*").alias("count"),
        F.min("line_no").alias("first_line"), F.max_by("last_line_no", "line_no").alias("last_line"), F.min_by("ts", "line_no").alias("first_seen"),
        F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("last_seen"), F.min_by(F.struct("line_no", "last_line_no", "message", "stack", "source", "next_start"), stacked).alias("sample"),
    )


def instances(held: DataFrame) -> DataFrame:
    """The first META members of each cluster, the first DETAILED of them in detail."""
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("line_no"))
    return held.withColumn("nth", nth).filter(F.col("nth") <= META).select("cluster_id", "nth", "line_no", "ts", F.when(F.col("nth") <= DETAILED, F.col("full_message")).alias("detail"))


def detailed(held: DataFrame, found: DataFrame) -> DataFrame:
    """The members that a report can show in full: the first DETAILED of each cluster, and its sample."""
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("line_no"))
    first = held.withColumn("nth", nth).filter(F.col("nth") <= DETAILED).drop("nth")
    sample = held.join(found.select("cluster_id", F.col("sample.line_no").alias("line_no")), ["cluster_id", "line_no"], "left_semi")
    return first.unionByName(sample).dropDuplicates(["cluster_id", "line_no"])


def correlation_ids(held: DataFrame) -> DataFrame:
    """Each cluster's first IDS distinct ids, by first line."""
    first = held.filter("correlation_id IS NOT NULL").groupBy("cluster_id", "correlation_id").agg(F.min("line_no").alias("at"))
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("at", "correlation_id"))
    return first.withColumn("nth", nth).filter(F.col("nth") <= IDS).select("cluster_id", "correlation_id", "nth")


def causes(held: DataFrame) -> DataFrame:
    """Each cluster's innermost causes with counts: the first CAUSES by first line, the rest as overflow (cause null)."""
    deep = held.withColumn("cause", deepest_cause(causal_lines(F.col("stack"), F.col("message")))).filter("cause <> ''")
    # whether the first entry that names a cause can be cited, where held knows it
    cited = [F.min_by("cited", "line_no").alias("cited")] if "cited" in held.columns else []
    by = deep.groupBy("cluster_id", "cause").agg(F.count("*").alias("count"), F.min("line_no").alias("first_line"), *cited)
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("first_line", "cause"))
    kept = by.withColumn("nth", nth)
    shown = F.when(F.col("nth") <= CAUSES, F.col("cause"))
    more = [F.min_by("cited", "first_line").alias("cited")] if cited else []
    return kept.withColumn("cause", shown).groupBy("cluster_id", "cause").agg(F.sum("count").alias("count"), F.min("first_line").alias("first_line"), *more)


def literal_tokens(template: Column) -> Column:
    """The distinct words of a template that are not masks, sorted."""
    bare = F.regexp_replace(template, r"\b0xH\b|\b[USHPN]\b", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")))


def distribution(clusters: DataFrame, key: str, top: int | None = 10) -> DataFrame:
    """key, n: entries by level or module, most first; the first top of them."""
    out = clusters.groupBy(key).agg(F.sum("count").alias("n")).orderBy(F.desc("n"), key)
    return out.limit(top) if top else out


def lookup(clusters: DataFrame, module: str | None = None, level: str | None = None, cluster_id: int | None = None) -> DataFrame:
    """Clusters of a module, a level (in any case), or with a number."""
    for column, value in (("module", module), ("level", level and level.upper()), ("cluster_id", cluster_id)):
        if value is not None:
            clusters = clusters.filter(F.col(column) == value)
    return clusters


def slots(held: DataFrame, most: int = 4, top: int = 3, first: int = 200) -> DataFrame:
    """What stands where a template has a mask: per cluster and slot the most frequent values of the first messages."""
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("line_no"))
    rows = held.withColumn("nth", nth).filter(F.col("nth") <= first).select("cluster_id", "founder", F.substring("full_message", 1, 200).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                parts = re.split(r"(\b0xH\b|\b[UHSPN]\b)", row.founder)
                pattern = "".join("(.+?)" if k % 2 else re.sub(r"(?:\\ )+", r"\\s+", re.escape(p)) for k, p in enumerate(parts))
                m = re.fullmatch(r"\s*" + pattern + r"\s*", row.text, re.S)
                for k, value in enumerate(m.groups()[:most] if m else ()):
                    out.append((row.cluster_id, k + 1, value))
            yield pd.DataFrame(out, columns=["cluster_id", "slot", "value"])

    values = rows.mapInPandas(run, "cluster_id int, slot int, value string").groupBy("cluster_id", "slot", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster_id", "slot").orderBy(F.desc("n"), "value"))
    return values.withColumn("rank", rank).filter(F.col("rank") <= top)
