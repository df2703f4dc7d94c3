"""Reports of the top clusters: Markdown, text, JSON, HTML and a brief summary."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions import text, times
from emberlog.plans.session import Result

FIELD_CHARS = 2000


def rows(result: Result, top: int | None = 20, custom: tuple[str, ...] = ()) -> list[dict]:
    """The top clusters as dictionaries, redacted on the way out."""
    cols = [F.col(c) for c in ("cluster_id", "level", "count", "module", "first_line", "last_line") if c in result.clusters.columns]
    shown = [times.show(F.col(c)).alias(c) for c in ("first_seen", "last_seen")]
    said = [text.redact(F.substring(F.col(c), 1, FIELD_CHARS), custom).alias(c) for c in ("template", "summary", "reason", "cause", "change_context") if c in result.clusters.columns]
    more = [F.col(c) for c in ("priority", "label", "confidence", "anomaly", "is_root_cause") if c in result.clusters.columns]
    stack = text.fold_stack(F.transform("sample.stack", lambda x: text.redact(x, custom)))["lines"].alias("stack")
    return [r.asDict(recursive=True) for r in result.top(top).select(*cols, *shown, *said, *more, stack).collect()]


def to_json(result: Result, top: int | None = 20, custom: tuple[str, ...] = ()) -> str:
    stats = result.stats.first().asDict()
    found = rows(result, top, custom)
    return json.dumps({"stats": stats, "verdict": result.verdict() if result.options.analyse else None, "shown": len(found), "total": result.clusters.count(), "clusters": found}, ensure_ascii=False, default=str)


def to_markdown(result: Result, top: int | None = 20, sections: tuple[str, ...] = ("overview", "list", "detail"), custom: tuple[str, ...] = ()) -> str:
    found, stats = rows(result, top, custom), result.stats.first()
    out = ["# Log report"]
    if "overview" in sections:
        out += ["", f"- entries: {stats.n_entries}, errors: {stats.n_errors}", f"- levels: {stats.level_counts}"]
        if result.options.analyse:
            v = result.verdict()
            out.append(f"- verdict: {v['verdict']}; missing: {', '.join(v['gaps']) or 'nothing'}")
    if "list" in sections:
        out += ["", "| # | level | count | lines | summary |", "|-|-|-|-|-|"]
        out += [f"| {r['cluster_id']} | {r['level']} | {r['count']} | {r['first_line']}~{r['last_line']} | {r['summary'].replace('|', chr(92) + '|')} |" for r in found]
    if "detail" in sections:
        for r in found:
            out += ["", f"## {r['cluster_id']}. {r['summary']}", "", f"{r['level']}, {r['count']} times, {r['first_seen']} to {r['last_seen']}"]
            if r.get("reason"):
                out.append(f"{r.get('confidence') or 'no conclusion'}: {r['reason']}")
            if r["stack"]:
                out += ["```", *r["stack"], "```"]
    return "\n".join(out) + "\n"


def to_text(result: Result, top: int | None = 20, custom: tuple[str, ...] = ()) -> str:
    return "\n".join(f"{r['level']:5} x{r['count']:<6} {r['first_line']}~{r['last_line']}  {r['summary']}" for r in rows(result, top, custom)) + "\n"


def to_html(result: Result, top: int | None = 20, custom: tuple[str, ...] = ()) -> str:
    body = "".join(f"<tr><td>{html.escape(r['level'])}<td>{r['count']}<td>{r['first_line']}~{r['last_line']}<td>{html.escape(r['summary'])}</tr>" for r in rows(result, top, custom))
    return f"<!doctype html><meta charset=utf-8><title>Log report</title><table><tr><th>level<th>count<th>lines<th>summary</tr>{body}</table>"


def brief(result: Result, top: int = 10) -> str:
    return to_text(result, top)


def compare_markdown(compared: DataFrame) -> str:
    out = ["| status | level | before | after | template |", "|-|-|-|-|-|"]
    out += [f"| {r.status} | {r.level} | {r.count_a} | {r.count_b} | {r.template} |" for r in compared.collect()]
    return "\n".join(out) + "\n"


FORMATS = {"md": to_markdown, "json": to_json, "text": to_text, "html": to_html}


def export(result: Result, kind: str, top: int | None = 20, custom: tuple[str, ...] = ()) -> str:
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {sorted(FORMATS)}")
    return FORMATS[kind](result, top, custom=custom)
