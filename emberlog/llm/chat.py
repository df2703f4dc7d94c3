"""Chat formatting: cumulative snapshots collapse into the longest conversation.

A logger that stores a conversation after each turn leaves many conversations that
are prefixes of a longer one.  A prefix hash is the exclusive-or of its turns' hashes, each
taken together with its place, so the hashes of all prefixes roll along the turns.
A conversation goes if its whole hash is that of a shorter part of another one
(an anti-join), or of an equal one with a smaller conv_id.

Turns are hashed in runs of RUN turn numbers, and only run totals are combined over a
whole conversation, so no task needs all turns of one.

Cases: rows without a conv_id belong to no conversation and are left out; rows that
repeat in all four columns count once; rows of one turn stand in the order of role and text, null last;
a null turn stands first; a null role or text is a value of its own and is
rendered empty; an empty table gives an empty table; other columns are ignored.  Turns that share a run (null turns are
one) are ordered in one task, by an external sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.scratch import materialize

RUN = 256
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _turn_hash(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def _keyed(turns: DataFrame) -> DataFrame:
    return turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text", _turn_hash("a").alias("a"), _turn_hash("b").alias("b"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), n (turns of the conversation), and the prefix hash (x, y) up to each place."""
    run = F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 62)))
    slim = _keyed(turns).distinct().withColumn("run", run)
    local = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    slim = materialize(slim.withColumn("k", F.row_number().over(local)).drop("role", "text"), "turns")
    over = Window.partitionBy("conv_id").orderBy("run")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    sizes = slim.groupBy("conv_id", "run").agg(F.count("*").alias("c"))
    offsets = sizes.select("conv_id", "run", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy("conv_id")).alias("n"))
    placed = slim.join(offsets, ["conv_id", "run"]).withColumn("place", F.col("base") + F.col("k"))
    placed = placed.select("conv_id", "run", "k", "place", "n", F.xxhash64("place", "a").alias("x"), F.xxhash64("place", "b").alias("y"))
    placed = materialize(placed, "placed")
    totals = placed.groupBy("conv_id", "run").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    carried = totals.select("conv_id", "run", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "xy"))
    rolling = Window.partitionBy("conv_id", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select("conv_id", "run", "place", "n", *(F.bit_xor(c).over(rolling).alias(c) for c in "xy"))
    return rolled.join(carried, ["conv_id", "run"]).select("conv_id", "place", "n", *(F.col(c).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in "xy"))


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations that are no prefix of another: conv_id, n_turns, n_same (equal ones, itself included)."""
    rolled = materialize(prefixes(turns), "prefixes")
    whole = rolled.filter("place = n").groupBy("place", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    shorter = rolled.filter("place < n").select("place", "x", "y").distinct()
    return whole.join(shorter, ["place", "x", "y"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_same")


def render(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """conv_id and chat: all turns of a conversation in one string (so one conversation has to fit in a task)."""
    head, middle, tail = (F.lit(x) for x in template)
    part = F.concat(head, F.coalesce("role", F.lit("")), middle, F.coalesce("text", F.lit("")), tail)
    rows = _keyed(turns).select("conv_id", "turn", "role", "text", part.alias("part")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", F.col("role").isNull().alias("mute"), "role", F.col("text").isNull().alias("bare"), "text", "part")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("chat"))


def collapse(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_same, chat."""
    kept = materialize(maximal(turns), "maximal")
    return kept.join(render(turns.join(kept.select("conv_id"), "conv_id", "left_semi"), template), "conv_id")
