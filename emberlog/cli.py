"""Command line: run, compare, verify, rules.  Exit codes: 0 done, 1 nothing or a difference found, 2 refused."""

from __future__ import annotations

import argparse
import json
import sys

from emberlog.operators import evidence, filters, rules
from emberlog.plans import report, session
from emberlog.sources import lines as source


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("emberlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("emberlog")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("files", nargs="+")
    run.add_argument("--format", default="md", choices=sorted(report.FORMATS))
    run.add_argument("--rule", default=None)
    run.add_argument("--level", default="ERROR,FAIL")
    run.add_argument("--include", default="")
    run.add_argument("--exclude", default="")
    run.add_argument("--similarity", default="standard")
    run.add_argument("--top", type=int, default=20)
    run.add_argument("--tail", type=int)
    run.add_argument("--max-lines", type=int)
    run.add_argument("--references", help="write references to the evidence here")
    two = sub.add_parser("compare")
    two.add_argument("files", nargs="+")
    check = sub.add_parser("verify")
    check.add_argument("references")
    sub.add_parser("rules")
    a = p.parse_args(argv)
    if a.command == "rules":
        print("\n".join(f"{r.name}: {', '.join(n for n, _ in r.patterns)}" for r in rules.PRESETS.values()))
        return 0
    spark = _session()
    if a.command == "run":
        if a.files == ["-"]:
            if a.tail:
                print("--tail needs a file", file=sys.stderr)
                return 2
            lines = source.from_text(spark, sys.stdin.read())
        else:
            lines = source.read_files(spark, a.files)
        if source.binary_guard(lines).filter("refused").limit(1).count():
            print("binary input", file=sys.stderr)
            return 2
        wanted = filters.Filter(levels=tuple(x.strip().upper() for x in a.level.split(",")), include=tuple(filters.split_keywords(a.include)), exclude=tuple(filters.split_keywords(a.exclude)))
        result = session.run(lines, session.Options(rule=a.rule, filter=wanted, similarity=a.similarity, tail=a.tail, max_lines=a.max_lines))
        print(report.export(result, a.format, a.top))
        if a.references:
            session.references(result).write.mode("overwrite").json(a.references)
        return 0 if result.clusters.limit(1).count() else 1
    if a.command == "compare":
        runs = [session.run(source.read_files(spark, [f]), session.Options(analyse=False)) for f in a.files]
        for other in runs[1:]:
            print(report.compare_markdown(session.compare_runs(runs[0], other)))
        return 0
    refs = spark.read.json(a.references)
    paths = [r.source for r in refs.select("source").distinct().collect()]
    row = evidence.verdict(evidence.verify(refs, source.read_files(spark, paths))).first()
    print(json.dumps(row.asDict()))
    return {"VERIFIED": 0, "NO_EVIDENCE": 1, "UNVERIFIABLE": 1}.get(row.verdict, 2)


if __name__ == "__main__":
    sys.exit(main())
