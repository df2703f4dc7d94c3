"""Lines to entries: each line's kind is its own, and runs of lines make entries.

Kinds: BLANK, START (begins an entry), IND_STACK and STACK (a stack line, indented or not), IND_PLAIN
(another indented line).  An entry is a START and what follows up to the next.  A following line is
stack if it is a stack line or a stack line came before it in the entry; else it goes on with the
message.  Lines before the first START are one entry of stack alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import levels, times
from emberlog.functions.text import strip
from emberlog.operators import structured
from emberlog.operators.rules import FLUSH, RuleSet, load
from emberlog.sources.shared import cut

BLOCK = 8192
HEAD = r"(?U)^([\w][\w.\-/]{0,63})\s*(?:\s[-|>]\s)"


def classify(lines: DataFrame, rule: str | RuleSet | None = None) -> DataFrame:
    """lines with kind, claim (what a structured line says) and m (the pattern's groups)."""
    rules = load(rule)
    text = F.col("text")
    blank = strip(text) == ""
    indented = text.rlike(r"^[ \t]")
    out = rules.with_match(structured.with_claim(lines))
    kind = (
        F.when(blank, "BLANK")
        .when(F.col("claim").isNotNull(), "START")
        .when(indented, F.when(rules.is_stack(text), "IND_STACK").otherwise("IND_PLAIN"))
        .when(text.rlike("(?U)" + FLUSH), "STACK")
        .when(F.col("m").isNotNull(), "START")
        .when(rules.is_stack(text), "STACK")
        .otherwise("START")
    )
    return out.withColumn("kind", kind)


def _parts(lines: DataFrame, rules: RuleSet, run: list[str]) -> DataFrame:
    """What each block of BLOCK lines holds of an entry: run, block, start (its START line, null if that stands in an earlier
    block), head, extra and stack lines.  A block is one group of one shuffle, however large its file."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # blank lines go by their text: a filter on their kind would be pushed below it and judge every line twice
    dealt = lines.filter(strip(F.col("text")) != "").withColumn("block", F.floor(F.col("line_no") / BLOCK)).repartition(parts, *run, "block")
    kept = classify(dealt, rules)
    over = Window.partitionBy(*run, "block").orderBy("line_no")
    kept = kept.withColumn("start", F.max(F.when(F.col("kind") == "START", F.col("line_no"))).over(over))
    inner = Window.partitionBy(*run, "block", "start").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("stacky", F.max(F.col("kind").isin("IND_STACK", "STACK")).over(inner))
    pile = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(flag & (F.col("kind") != "START"), F.struct("line_no", "text")))), lambda x: x["text"])
    head = F.first(F.when(F.col("kind") == "START", F.struct("text", "claim", "m")), ignorenulls=True)
    held = kept.groupBy(*run, "block", "start").agg(
        F.min_by("source", "line_no").alias("source"), F.min("line_no").alias("line_no"), F.max("line_no").alias("last_line_no"),
        F.min_by("file_line_no", "line_no").alias("file_line_no"), F.max_by("file_line_no", "line_no").alias("file_last_line_no"),
        F.min_by("text", "line_no").alias("raw"), head.alias("head"), pile(~F.col("stacky")).alias("extra"), pile(F.col("stacky")).alias("stack"),
    )
    return held.withColumn("after", F.lead("start").over(Window.partitionBy(*run, "block").orderBy(F.col("start").asc_nulls_first())))


def _whole(parts: DataFrame, run: list[str]) -> DataFrame:
    """Entries of parts: run, start (0 for lines before the first START), next_start and what the parts say.

    Only what a block has at its end and the next ones at their beginning is put together; all other parts are entries as
    they are.  What blocks carry to each other is one row a block.
    """
    blocks = parts.groupBy(*run, "block").agg(F.max("start").alias("last"), F.min("start").alias("first"), F.max(F.col("start").isNull()).alias("goes_on"))
    order = Window.partitionBy(*run).orderBy("block")
    carried = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing))
    blocks = blocks.select(*(F.col(c).alias(f"b_{c}") for c in run), F.col("block").alias("b_block"), "last", carried.alias("carried"), ahead.alias("ahead"), F.coalesce(F.lead("goes_on").over(order), F.lit(False)).alias("tail"))
    same = (F.col("block") == F.col("b_block")) if not run else (F.col("block") == F.col("b_block")) & (F.col(run[0]) == F.col(f"b_{run[0]}"))
    placed = parts.join(blocks, same).withColumn("next_start", F.coalesce("after", "ahead"))
    placed = placed.withColumn("open", F.col("start").isNull() | (F.col("tail") & (F.col("start") == F.col("last")))).withColumn("start", F.coalesce("start", "carried", F.lit(0)))
    cols = (*run, "start", "source", "line_no", "last_line_no", "file_line_no", "file_last_line_no", "raw", "head", "next_start")
    none = F.array().cast("array<string>")
    alone = placed.filter(~F.col("open")).select(*cols, "extra", "stack")
    pieces = F.array_sort(F.collect_list(F.struct("block", "extra", "stack")))

    def joined(acc, p):
        on = (F.size(acc["stack"]) > 0) | (F.col("start") == 0)
        return F.struct(F.when(on, acc["extra"]).otherwise(F.concat(acc["extra"], p["extra"])).alias("extra"), F.when(on, F.concat(acc["stack"], p["extra"], p["stack"])).otherwise(F.concat(acc["stack"], p["stack"])).alias("stack"))

    some = placed.filter("open").groupBy(*run, "start").agg(
        F.min_by("source", "line_no").alias("source"), F.min("line_no").alias("line_no"), F.max("last_line_no").alias("last_line_no"), F.min_by("file_line_no", "line_no").alias("file_line_no"),
        F.max_by("file_last_line_no", "last_line_no").alias("file_last_line_no"), F.min_by("raw", "line_no").alias("raw"), F.first("head", ignorenulls=True).alias("head"), F.min("next_start").alias("next_start"), pieces.alias("pieces"),
    )
    some = some.withColumn("x", F.aggregate("pieces", F.struct(none.alias("extra"), none.alias("stack")), joined)).select(*cols, "x.extra", "x.stack")
    return alone.unionByName(some)


def entries(lines: DataFrame, rule: str | RuleSet | None = None, span_files: bool = False) -> DataFrame:
    """Entries of lines; with span_files an entry may go on in the next file of the run.

    Lines are classified and grouped in blocks, so that one file, or one run of many, is many tasks.
    """
    rules = load(rule)
    run = [] if span_files else ["file_seq"]
    return describe(_whole(cut(_parts(lines, rules, run), "parts"), run), rules, run)


def describe(grouped: DataFrame, rules: RuleSet, run: list[str]) -> DataFrame:
    """What entries say, from their lines: run, source, start (0: no START line), places, raw, head, extra and stack lines."""
    out = grouped.withColumn("message_extra", F.transform("extra", strip))
    c, m = F.col("head.claim"), F.col("head.m")
    # each step is a column of its own, so that no expression is written out twice in the plan
    out = out.withColumn("said", F.coalesce(c["message"], m["message"], F.when(F.col("start") > 0, F.col("head.text")), F.lit("")))
    out = out.withColumn("spelled", F.coalesce(c["level"], m["level"])).withColumn("stamp", F.coalesce(c["timestamp"], m["timestamp"])).withColumn("named", F.coalesce(c["module"], m["module"]))
    out = out.withColumn("given", F.when(F.col("spelled").isNotNull(), levels.normalize(F.col("spelled")))).withColumn("token", F.regexp_extract("said", HEAD, 1))
    out = out.withColumn("token_level", F.when(F.col("token") != "", levels.canonical(F.col("token"))))
    out = out.withColumn("as_level", F.col("given").isNull() & F.col("token_level").isNotNull())
    out = out.withColumn("as_module", (F.col("token") != "") & ~F.col("as_level") & F.col("named").isNull() & F.col("token_level").isNull())
    out = out.withColumn("message", F.when(F.col("as_level") | F.col("as_module"), strip(F.regexp_replace("said", HEAD, ""))).otherwise(F.col("said")))
    level = F.when(F.col("start") == 0, F.coalesce(rules.infer_level(F.col("raw")), F.lit("ERROR"))).otherwise(F.coalesce("given", F.when(F.col("as_level"), F.col("token_level")), rules.infer_level(F.col("message")), F.lit("INFO")))
    error = c["error"]
    stack = F.when(error.isNotNull() & ~F.contains("message", F.coalesce(error, F.lit(""))), F.concat(F.array(error), F.col("stack"))).otherwise(F.col("stack"))
    module = strip(F.coalesce("named", F.when(F.col("as_module"), F.col("token")), F.lit("")))
    return out.select(
        *run, "source", "line_no", "last_line_no", "file_line_no", "file_last_line_no", "next_start", "raw",
        times.parse(F.col("stamp")).alias("ts"), level.alias("level"), module.alias("module"), "message", "message_extra", stack.alias("stack"), F.array_join(F.concat(F.array("message"), F.col("message_extra")), " ").alias("full_message"),
        c["trace_id"].alias("trace_id"), c["request_id"].alias("request_id"), c["span_id"].alias("span_id"), F.coalesce(c["request_id"], c["trace_id"]).alias("correlation_id"), c.isNotNull().alias("structured"), c["fields"].alias("fields"), F.coalesce(m["pattern"], F.lit("")).alias("pattern"),
    )
