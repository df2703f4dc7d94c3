"""Time: histograms whose width fits the range, bursts, periods, surges, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLUSTER_BUCKETS, GLOBAL_BUCKETS, GROWTH = 96, 512, 8
NEAR = 60


def width(span: Column, cap: int) -> Column:
    """The least power of GROWTH seconds that cuts the span into fewer than cap buckets."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.pow(F.lit(float(GROWTH)), k))
    return F.element_at(F.filter(tries, lambda w: F.floor(span / w) < cap), 1)


def histogram(entries: DataFrame, keys: tuple[str, ...] = (), cap: int = CLUSTER_BUCKETS) -> DataFrame:
    """keys, t (start of the bucket), n, width.  Buckets count from the first timestamp."""
    stamped = entries.filter("ts IS NOT NULL")
    spans = stamped.groupBy(*keys).agg(F.min("ts").alias("origin"), width(F.max("ts") - F.min("ts"), cap).alias("width"))
    joined = stamped.join(spans, list(keys)) if keys else stamped.join(F.broadcast(spans))
    t = F.col("origin") + F.floor((F.col("ts") - F.col("origin")) / F.col("width")) * F.col("width")
    return joined.groupBy(*keys, t.alias("t"), "width").agg(F.count("*").alias("n"))


def bursts(hist: DataFrame, keys: tuple[str, ...] = (), k: float = 3.0) -> DataFrame:
    """Buckets well above the usual: n > max(median + k * 1.4826 * MAD, 2 * median), of two buckets or more."""
    over = Window.partitionBy(*keys)
    first = hist.withColumn("median", F.median("n").over(over)).withColumn("buckets", F.count("*").over(over))
    second = first.withColumn("mad", F.median(F.abs(F.col("n") - F.col("median"))).over(over))
    limit = F.greatest(F.col("median") + k * 1.4826 * F.col("mad"), 2 * F.col("median"))
    return second.withColumn("limit", limit).filter((F.col("buckets") >= 2) & (F.col("n") > F.col("limit"))).select(*keys, "t", "n", "limit")


def own_bursts(hist: DataFrame, key: str = "cluster_id", k: float = 3.0, buckets: int = 3, peak: int = 5) -> DataFrame:
    """Clusters whose peak stands out of their own histogram (of three buckets or more, peak of five or more)."""
    enough = hist.groupBy(key).agg(F.count("*").alias("b"), F.max("n").alias("peak")).filter((F.col("b") >= buckets) & (F.col("peak") >= peak))
    hot = bursts(hist, (key,), k).groupBy(key).agg(F.max("n").alias("high"), F.max("limit").alias("limit"))
    return enough.join(hot, key).filter("high = peak").select(key, "peak", "limit")


def global_bursts(entries: DataFrame, hist: DataFrame, key: str = "cluster_id", k: float = 3.0) -> DataFrame:
    """Clusters whose peak (the first of equals, hist: their own histogram) begins in a bucket in which all entries burst.

    Buckets of both meet by their number on the global scale, an equi-join."""
    every = histogram(entries, (), GLOBAL_BUCKETS)
    scale = every.agg(F.min("t").alias("origin"), F.first("width").alias("step"))
    hot = bursts(every, (), k).select("t").join(F.broadcast(scale)).select(F.round((F.col("t") - F.col("origin")) / F.col("step")).cast("long").alias("slot"))
    peaks = hist.groupBy(key).agg(F.min_by("t", F.struct((-F.col("n")).alias("a"), F.col("t").alias("b"))).alias("peak_t")).join(F.broadcast(scale))
    return peaks.withColumn("slot", F.floor((F.col("peak_t") - F.col("origin")) / F.col("step")).cast("long")).join(F.broadcast(hot), "slot", "left_semi").select(key, "peak_t")


def periodic(held: DataFrame, key: str = "cluster_id", variation: float = 0.10, least: int = 4) -> DataFrame:
    """Clusters whose steps in time are even: deltas over 1 ms, their population CV at most variation."""
    delta = F.col("ts") - F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "line_no"))
    steps = held.filter("ts IS NOT NULL").withColumn("delta", delta).filter("delta > 0.001")
    by = steps.groupBy(key).agg(F.count("*").alias("steps"), F.avg("delta").alias("period"), F.stddev_pop("delta").alias("sd"))
    return by.withColumn("cv", F.col("sd") / F.col("period")).filter((F.col("steps") >= least - 1) & (F.col("cv") <= variation)).select(key, "steps", "period", "cv")


def near_join(left: DataFrame, right: DataFrame, reach: int = NEAR) -> DataFrame:
    """Pairs of rows (t, t2) at most reach apart, by an equi-join on buckets of that size and their neighbours."""
    a = left.withColumn("b", F.explode(F.array(*(F.floor(F.col("t") / reach) + k for k in (-1, 0, 1)))))
    b = right.withColumn("b", F.floor(F.col("t2") / reach))
    return a.join(b, "b").filter(F.abs(F.col("t") - F.col("t2")) <= reach).drop("b")


def cooccurrence(held: DataFrame, reach: int = NEAR, least: int = 2) -> DataFrame:
    """Ordered pairs of clusters with how often an instance of the second stands near one of the first.

    Instances are counted by second first, so a hot cluster meets another second by second, not line by line.
    """
    by = held.filter("ts IS NOT NULL").groupBy("cluster_id", "ts").agg(F.count("*").alias("n"))
    left = by.select("cluster_id", F.col("ts").alias("t"), F.col("n").alias("n1"))
    right = by.select(F.col("cluster_id").alias("other"), F.col("ts").alias("t2"), F.col("n").alias("n2"))
    near = near_join(left, right, reach).filter("cluster_id <> other")
    return near.groupBy("cluster_id", "other").agg(F.sum(F.col("n1") * F.col("n2")).alias("hits")).filter(F.col("hits") >= least)


def surge(held: DataFrame, start: float, end: float, least: int = 2, z: float = 2.0) -> DataFrame:
    """Clusters with significantly more entries in [start, end] than their rate elsewhere says (Poisson z)."""
    bounds = held.filter("ts IS NOT NULL").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    inside = F.col("ts").between(start, end)
    by = held.filter("ts IS NOT NULL").groupBy("cluster_id").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))
    clipped = F.greatest(F.least(F.lit(end), F.col("hi")) - F.greatest(F.lit(start), F.col("lo")), F.lit(0.0))
    rest = F.greatest(F.col("hi") - F.col("lo") - clipped, F.lit(1.0))
    expected = F.col("outside") / rest * clipped
    scored = by.join(F.broadcast(bounds)).withColumn("expected", expected).withColumn("z", (F.col("inside") - F.col("expected")) / F.sqrt(F.greatest(F.col("expected"), F.lit(1.0))))
    return scored.filter((F.col("inside") >= least) & (F.col("z") >= z)).select("cluster_id", "inside", "expected", "z")


def first_in_window(clusters: DataFrame, size: int = 60, least: int = 2) -> DataFrame:
    """The earliest cluster of each tumbling window of first_seen that holds least or more."""
    slot = F.floor(F.col("first_seen") / size)
    over = Window.partitionBy("slot")
    ranked = clusters.filter("first_seen IS NOT NULL").withColumn("slot", slot).withColumn("held", F.count("*").over(over)).withColumn("nth", F.row_number().over(over.orderBy("first_seen", "first_line")))
    return ranked.filter((F.col("held") >= least) & (F.col("nth") == 1)).select("cluster_id", "slot", "held")
