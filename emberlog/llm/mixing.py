"""Mixing sources to target weights by entropy balancing.

Among all document rates r, the entropy-balanced ones are nearest to 1 (in relative entropy, each document
weighed by its tokens) under token constraints:
  * for each source, the sum of r * size over its documents is its target;
  * over the whole mix, the mean size class (floor of log2 of a document's size) of a token is that of the corpus, so
    that raising a source of short documents does not make the mix a mix of short documents;
  * no r is above MOST.
The convex dual has one multiplier a source and one that all sources share, and the rates are exponential tilts
r = min(MOST, exp(multiplier of the source + shared multiplier * centred size class)).  The second constraint is soft: the dual
holds SOFT * tokens / 2 * (shared multiplier) ** 2 more, so that a few very long documents don't tilt all others away; it is met in
part where that takes gentle tilts, and given up where it can't be met.

A document enters the dual through its source and size class alone, so its tokens are added up once, in a distributed
aggregation over all documents, into cells.  Each Newton step is one more aggregation over all cells: the
Hessian is an arrow (a diagonal and the shared row), and its Schur complement leaves one row of totals for the driver.  Sources
whose target is MOST times their size have no freedom; all their rates are MOST.

Rates become copies by systematic rounding in whole millionths: within a source (cut into salted runs, so that no source is
ordered in one task) documents stand by size, and a document gets as many copies as the running sum of rates passes
halves: floor(r) or ceil(r), at most MOST, spread evenly over all sizes.

Cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, the last; a source without
words has target 0 and no copies; repeated rows are documents of their own (rows that are equal in all columns can't be told
apart, so it doesn't matter which of them is taken); a null doc_id is an id like any other; an empty table gives an empty table;
other columns pass through ``mixture`` whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
RUN = 4096
SOFT = 1.0
STEPS = 60
CLOSE = 1e-9
UNIT = 1_000_000
SALTS = 16
#: The longest Newton step in a source's multiplier and in the shared one.
LONGEST, LONGEST_SHARED = 1.0, 0.25


def size_of(text: Column) -> Column:
    """The number of words: a word begins at a non-space that begins the text or follows a space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def class_of(size: Column) -> Column:
    """floor(log2(size)), 0 for 0."""
    return (F.length(F.bin(F.greatest(size, F.lit(1)))) - 1).cast("long")


def _weights(by: DataFrame) -> DataFrame:
    """by (one row a source) with its weight: WEIGHTS in the order of sources by code point, null last.

    Sources are sorted over all tasks; a row's place is its place in its partition plus the rows of
    all partitions before it, of which there are as many as partitions.
    """
    parts = int(by.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = by.repartitionByRange(parts, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    spot = F.monotonically_increasing_id()
    return laid.select("*", F.shiftright(spot, 33).cast("long").alias("part"), spot.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))


def targets(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """Per source of the cells (source, class, n, mass): n (documents), source_size, weight, target.

    Sources share all tokens by weight; those above MOST times their size stop there and the excess is shared
    again, until none is above.
    """
    by = scratch.keep(_weights(cells.groupBy("source").agg(F.sum("n").alias("n"), F.sum("mass").alias("source_size"))), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = by.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    place = (F.col("base") + F.col("nth")) % len(WEIGHTS)
    by = scratch.keep(by.join(F.broadcast(offsets), "part").select("source", "n", "source_size", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("long").alias("weight")), "weights")
    capped, level = F.lit(False), None
    while True:
        row = by.agg(F.sum("source_size").alias("total"), F.sum(F.when(capped, F.col("source_size") * MOST)).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("weights")).first()
        total, held, weights = row["total"] or 0, row["held"] or 0, row["weights"] or 0
        now = (total - held) / weights if weights else math.inf
        if level is not None and now <= level:
            break
        level = now
        capped = F.col("source_size") * MOST <= F.lit(level) * F.col("weight")
    return by.withColumn("target", F.least((F.col("source_size") * MOST).cast("double"), F.lit(level) * F.col("weight")))


def rates(cells: DataFrame, by: DataFrame, scratch: Scratch) -> DataFrame:
    """source, class and rate (in UNIT-ths) of all cells, by Newton steps on the dual."""
    sums = cells.agg(F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.col("class")).alias("moment")).first()
    tokens = sums["mass"] or 0
    middle = sums["moment"] / tokens if tokens else 0.0
    x, mass = F.col("class") - F.lit(middle), F.col("mass").cast("double")
    bound = F.col("target") >= F.col("source_size") * MOST
    named = by.select(F.col("source").alias("named"), "source_size", "target", bound.alias("bound"))
    whole = scratch.keep(cells.join(named, cells["source"].eqNullSafe(named["named"])).drop("named"), "cells")
    fixed = whole.filter("bound").agg(F.sum(MOST * mass * x)).first()[0] or 0.0
    free = whole.filter("NOT bound AND target > 0").select("source", "class", "mass", "target")
    held = by.filter(~bound & (F.col("target") > 0)).select(F.col("source").alias("named"), F.log(F.col("target") / F.col("source_size")).alias("own"))
    shared, soft = 0.0, SOFT * tokens
    for _ in range(STEPS):
        tilt = F.exp(F.col("own") + shared * x)
        open_ = F.when(tilt < MOST, mass * tilt).otherwise(F.lit(0.0))
        rows = free.join(held, free["source"].eqNullSafe(held["named"]))
        per = rows.groupBy("source", "target", "own").agg(F.sum(mass * F.least(tilt, F.lit(float(MOST)))).alias("a"), F.sum(open_).alias("b"), F.sum(open_ * x).alias("d"), F.sum(open_ * x * x).alias("e"), F.sum(mass * F.least(tilt, F.lit(float(MOST))) * x).alias("p"))
        per = scratch.keep(per.withColumn("g", F.col("target") - F.col("a")).withColumn("b", F.greatest("b", F.col("target") * 1e-6)), "step")
        t = per.agg(F.sum(F.col("d") * F.col("g") / F.col("b")).alias("dg"), F.sum(F.col("d") * F.col("d") / F.col("b")).alias("dd"), F.sum("e").alias("e"), F.sum("p").alias("p"), F.max(F.abs(F.col("g")) / F.col("target")).alias("off")).first()
        if t["off"] is None:
            break
        move = (-(t["p"] + fixed) - soft * shared - t["dg"]) / max(t["e"] + soft - t["dd"], soft)
        move = max(-LONGEST_SHARED, min(LONGEST_SHARED, move))
        held = per.select(F.col("source").alias("named"), (F.col("own") + F.greatest(F.lit(-LONGEST), F.least(F.lit(LONGEST), (F.col("g") - F.col("d") * move) / F.col("b")))).alias("own"))
        shared += move
        if t["off"] < CLOSE and abs(move) < CLOSE:
            break
    rate = F.when(F.col("bound") & (F.col("target") > 0), F.lit(float(MOST))).when(F.col("own").isNotNull(), F.least(F.exp(F.col("own") + shared * x), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    return whole.join(held, whole["source"].eqNullSafe(held["named"]), "left").select("source", "class", F.round(rate * UNIT).cast("long").alias("rate"))


def _copies(docs: DataFrame, scratch: Scratch, cells: DataFrame) -> DataFrame:
    """docs (row, source, size, key, print) with source_size, target, rate and copies; key orders documents of one size, print those of one key."""
    by = targets(cells, scratch)
    tilts = scratch.keep(rates(cells, by, scratch), "rates")
    by = by.select(F.col("source").alias("_s"), "n", "source_size", "target")
    tilts = tilts.join(by, tilts["source"].eqNullSafe(by["_s"])).select(F.col("source").alias("_s"), F.col("class").alias("_c"), "rate", "n", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    docs = docs.withColumn("_class", class_of(F.col("size"))).withColumn("_deal", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    joined = docs.join(tilts, docs["source"].eqNullSafe(tilts["_s"]) & (docs["_class"] == tilts["_c"]) & (docs["_deal"] == tilts["_salt"]))
    run = F.conv(F.substring("key", 1, 6), 16, 10).cast("long") % F.ceil(F.col("n") / RUN)
    passed = F.sum("rate").over(Window.partitionBy("source", "run").orderBy("size", "key", "print").rowsBetween(Window.unboundedPreceding, 0))
    half = F.lit(UNIT // 2)
    whole = lambda c: F.floor((c + half) / UNIT)
    placed = joined.withColumn("run", run).withColumn("passed", passed)
    return placed.withColumn("copies", (whole(F.col("passed")) - whole(F.col("passed") - F.col("rate"))).cast("int"))


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def _cells(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source", class_of(F.col("size")).alias("class")).agg(F.count("*").alias("n"), F.sum("size").alias("mass"))


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), rate, copies."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    cells = scratch.keep(_cells(sized), "cells")
    out = _copies(sized.select("doc_id", "source", "size", _key(F.col("doc_id")).alias("key"), F.lit(0).alias("print")), scratch, cells)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), (F.col("rate") / UNIT).alias("rate"), "copies")


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs.

    Rows of one source, size and doc_id stand in the order of a hash of all their columns.  Texts are shuffled once.
    """
    scratch = Scratch(docs.sparkSession)
    size = size_of(F.col("text"))
    cells = scratch.keep(_cells(docs.select("source", size.alias("size"))), "cells")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", size.alias("size"), _key(F.col("doc_id")).alias("key"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("print"))
    taken = _copies(rows, scratch, cells).filter("copies > 0").select("row", "copies")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
