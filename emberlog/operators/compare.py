"""Run-to-run comparison: which kinds of entries are new, gone, or more or less frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.sources.shared import cut


def by_template(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: level, template, count.  One row a kind: status, count_a, count_b, change (per cent)."""
    x = a.groupBy("level", "template").agg(F.sum("count").alias("count_a"))
    y = b.groupBy("level", "template").agg(F.sum("count").alias("count_b"))
    both = x.join(y, ["level", "template"], "full_outer")
    status = F.when(F.col("count_a").isNull(), "new").when(F.col("count_b").isNull(), "gone").otherwise("common")
    change = F.when(status == "common", 100.0 * (F.col("count_b") - F.col("count_a")) / F.col("count_a"))
    return both.select("level", "template", status.alias("status"), F.coalesce("count_a", F.lit(0)).alias("count_a"), F.coalesce("count_b", F.lit(0)).alias("count_b"), change.alias("change"))


def by_trace(compared: DataFrame, ids_a: DataFrame, ids_b: DataFrame) -> DataFrame:
    """Of the new and gone kinds those that share a correlation id, whatever their levels, one to one: via, level_a, template_a,
    level_b, template_b.

    Candidates stand in the order of id, new kind, gone kind, and one is taken if both its kinds are still free.  That
    is what rounds come to which take all candidates that are the first of both kinds and drop what these kinds had, until none is left.
    """
    sides = {}
    for status, ids, x in (("gone", ids_a, "a"), ("new", ids_b, "b")):
        kinds = compared.filter(F.col("status") == status).select("level", "template").join(ids, ["level", "template"]).distinct()
        sides[x] = kinds.select(F.col("level").alias(f"level_{x}"), F.col("template").alias(f"template_{x}"), F.col("correlation_id").alias("via"))
    a, b = ["level_a", "template_a"], ["level_b", "template_b"]
    left = cut(sides["a"].join(sides["b"], "via"), "candidates")
    order = ["via", "template_b", "level_b", "template_a", "level_a"]
    taken = left.limit(0)
    while True:
        first = lambda kind: F.row_number().over(Window.partitionBy(*kind).orderBy(*order))
        now = cut(left.withColumn("i", first(a)).withColumn("j", first(b)).filter("i = 1 AND j = 1").drop("i", "j"), "pairs")
        if not now.limit(1).count():
            return taken
        taken = taken.unionByName(now)
        left = cut(left.join(now.select(*a), a, "left_anti").join(now.select(*b), b, "left_anti"), "candidates")


def with_traces(compared: DataFrame, pairs: DataFrame) -> DataFrame:
    """compared with the pairs of by_trace as common kinds: new and gone are what is left."""
    counts = lambda status, x, n: compared.filter(F.col("status") == status).select(F.col("level").alias(f"level_{x}"), F.col("template").alias(f"template_{x}"), n)
    joined = pairs.join(counts("gone", "a", "count_a"), ["level_a", "template_a"]).join(counts("new", "b", "count_b"), ["level_b", "template_b"])
    common = joined.select(F.col("level_b").alias("level"), F.col("template_b").alias("template"), F.lit("common").alias("status"), "count_a", "count_b", (100.0 * (F.col("count_b") - F.col("count_a")) / F.nullif("count_a", F.lit(0))).alias("change"))
    used = pairs.select(F.col("level_a").alias("level"), F.col("template_a").alias("template"), F.lit("gone").alias("status")).unionByName(pairs.select(F.col("level_b").alias("level"), F.col("template_b").alias("template"), F.lit("new").alias("status")))
    return compared.join(used, ["level", "template", "status"], "left_anti").select(common.columns).unionByName(common)


def ordered(compared: DataFrame) -> DataFrame:
    """New by count, gone by count, common by size of the change."""
    rank = F.when(F.col("status") == "new", 0).when(F.col("status") == "gone", 1).otherwise(2)
    key = F.when(F.col("status") == "new", F.col("count_b")).when(F.col("status") == "gone", F.col("count_a")).otherwise(F.abs("change"))
    return compared.orderBy(rank, F.desc(key), "level", "template")


def many(runs: list[DataFrame]) -> list[DataFrame]:
    """The first run against each other one."""
    return [by_template(runs[0], other) for other in runs[1:]]
