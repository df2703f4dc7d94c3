"""Entry filters: levels, keywords, patterns, time; and what they leave out."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import levels, times
from emberlog.functions.text import causal_lines, has_cause

# Fixed value: what counts as a change of the running system.
CHANGE = (
    r"(?i)(?:started\s+\S.*\sin\s+\d+(?:\.\d+)?\s*(?:s|sec|seconds|ms)\b|\bstarting\s+(?:up\s+)?(?:version|service|server|application)\b"
    r"|\bshutting\s+down\b|\bshutdown\s+(?:initiated|complete|completed|requested)\b|\bstopped\s+(?:the\s+)?(?:service|server|daemon|instance|application)\b"
    r"|\brestarted\b|\bdeploy(?:ed|ing|ment)\b|\brollback\b|\bupgrad(?:ed|ing)\b|\bversion\s+\S+\s+(?:started|released|deployed)\b|\bSIGTERM\b|\bSIGKILL\b"
    r"|服务(?:启动|重启|停止|发布|上线|下线)|系统(?:启动|重启)|(?:发布|发版|上线|下线|停机|重启)(?:完成|开始|成功|失败)?)"
)
MAX_CHANGES = 200


@dataclass(frozen=True)
class Filter:
    levels: tuple[str, ...] = levels.ERRORS
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_re: tuple[str, ...] = ()
    exclude_re: tuple[str, ...] = ()
    start: float | None = None
    end: float | None = None
    day_start: int | None = None
    day_end: int | None = None

    def __post_init__(self) -> None:
        for pattern in (*self.include_re, *self.exclude_re):
            re.compile(pattern)


def in_time(f: Filter, ts: Column | None = None) -> Column:
    """Entries without a timestamp always pass; a day range whose start lies after its end wraps over midnight."""
    ts = F.col("ts") if ts is None else ts
    out = F.lit(True)
    if f.start is not None:
        out &= ts >= f.start
    if f.end is not None:
        out &= ts <= f.end
    second = times.second_of_day(ts)
    if f.day_start is not None and f.day_end is not None and f.day_start > f.day_end:
        out &= (second >= f.day_start) | (second <= f.day_end)
    else:
        if f.day_start is not None:
            out &= second >= f.day_start
        if f.day_end is not None:
            out &= second <= f.day_end
    return ts.isNull() | out


def matches(f: Filter) -> Column:
    """Levels, then exclusions, then inclusions (any of them), over module, message and stack."""
    body = F.lower(F.concat_ws("\n", "module", "full_message", "stack"))
    out = F.col("level").isin(*f.levels) if f.levels else F.lit(True)
    for word in f.exclude:
        out &= ~body.contains(word.lower())
    for pattern in f.exclude_re:
        out &= ~body.rlike(f"(?i){pattern}")
    wanted = [body.contains(w.lower()) for w in f.include] + [body.rlike(f"(?i){p}") for p in f.include_re]
    if wanted:
        any_of = wanted[0]
        for w in wanted[1:]:
            any_of |= w
        out &= any_of
    return out


def changes(entries: DataFrame) -> DataFrame:
    """The first MAX_CHANGES entries, not errors, that tell of a start, stop or release."""
    kept = entries.filter(~F.col("level").isin(*levels.ERRORS) & F.col("full_message").rlike(CHANGE))
    return kept.select("line_no", "source", "ts", F.substring("full_message", 1, 200).alias("text")).orderBy("line_no").limit(MAX_CHANGES)


# From how many entries on, and up to which share of them kept, a filter is worth a word.
NOTICE_ENTRIES, NOTICE_SHARE = 50, 0.15


def notice(entries: DataFrame, f: Filter) -> DataFrame:
    """One row if the filter leaves next to nothing: total, kept, causal_dropped, level_counts (by count), text; else none.

    causal_dropped counts entries left out that are no errors and name a cause: the root cause may be among them."""
    lines = causal_lines(F.col("stack"), F.col("message"))
    kept = F.coalesce(matches(f), F.lit(False))
    lost = ~kept & ~F.col("level").isin(*levels.ERRORS) & has_cause(lines)
    by = entries.groupBy("level").agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"), F.count_if(lost).alias("lost"))
    one = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("lost"), F.lit(0)).alias("causal_dropped"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "level"))).alias("x"))
    counts = F.transform("x", lambda v: F.struct(v["level"].alias("level"), (-v["k"]).alias("n")))
    shown = F.array_join(F.transform(F.slice("level_counts", 1, 5), lambda v: F.concat_ws(" ", v["level"], v["n"].cast("string"))), " / ")
    warning = F.when(F.col("causal_dropped") > 0, F.format_string("%d entries that were left out name a cause. ", "causal_dropped")).otherwise("")
    said = F.concat(warning, F.format_string("The filter keeps %d of %d entries (%.1f%%); levels: ", "kept", "total", 100 * F.col("kept") / F.col("total")), shown)
    few = (F.col("total") >= NOTICE_ENTRIES) & (F.col("kept") <= NOTICE_SHARE * F.col("total"))
    return one.filter(few).withColumn("level_counts", counts).select("total", "kept", "causal_dropped", "level_counts", said.alias("text"))


def split_keywords(text: str) -> list[str]:
    """Keywords of one input field, cut at commas, semicolons and line ends of any width."""
    return [w.strip() for w in re.split(r"[,;，；、\n]", text) if w.strip()]


def boolean(expression: str, columns: tuple[str, ...] = ("summary", "module", "level", "template")) -> Column:
    """A condition from words joined by and, or, not and brackets; words are looked for anywhere, in any case."""
    body = F.lower(F.concat_ws(" ", *columns))
    parts = re.findall(r'"[^"]*"|\(|\)|[^\s()]+', expression)
    at = 0

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(parts) and parts[at].lower() == "or":
            at += 1
            out |= both()
        return out

    def both() -> Column:
        nonlocal at
        out = one()
        while at < len(parts) and parts[at] != ")" and parts[at].lower() != "or":
            if parts[at].lower() == "and":
                at += 1
            out &= one()
        return out

    def one() -> Column:
        nonlocal at
        if at >= len(parts):
            raise ValueError(f"unfinished: {expression}")
        part = parts[at]
        at += 1
        if part.lower() == "not":
            return ~one()
        if part == "(":
            inner = either()
            if at >= len(parts) or parts[at] != ")":
                raise ValueError(f"unclosed bracket: {expression}")
            at += 1
            return inner
        return body.contains(part.strip('"').lower())

    if not parts:
        return F.lit(True)
    out = either()
    if at < len(parts):
        raise ValueError(f"cannot read {parts[at]} in {expression}")
    return out


def stats(entries: DataFrame) -> DataFrame:
    """One row: entries, errors, counts by level, the range of time and the number of stamped entries."""
    by = entries.groupBy("level").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("ts").alias("stamped"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"), F.coalesce(F.sum(F.when(F.col("level").isin(*levels.ERRORS), F.col("n"))), F.lit(0)).alias("n_errors"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("level_counts"), F.min("a").alias("time_start"), F.max("b").alias("time_end"), F.coalesce(F.sum("stamped"), F.lit(0)).alias("stamped"),
    )
