"""One call from lines to conclusions: the plan of a whole run, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import analysis, assemble, cluster, compare, evidence, filters, rules, timeline
from emberlog.sources import lines as source
from emberlog.sources.shared import cut


@dataclass(frozen=True)
class Options:
    rule: str | rules.RuleSet | None = None
    filter: filters.Filter = field(default_factory=filters.Filter)
    similarity: str | float = "standard"
    context: int = 50
    max_lines: int | None = None
    tail: int | None = None
    deep: bool = False
    analyse: bool = True

    @property
    def threshold(self) -> float:
        return self.similarity if isinstance(self.similarity, float) else cluster.TIERS.get(self.similarity, cluster.TIERS["standard"])


@dataclass
class Result:
    """DataFrames of a run, most of them tables that are written already."""

    lines: DataFrame
    entries: DataFrame
    kept: DataFrame
    members: DataFrame
    clusters: DataFrame
    stats: DataFrame
    changes: DataFrame
    traces: DataFrame
    chains: DataFrame
    options: Options

    def top(self, n: int | None = 20) -> DataFrame:
        """Errors first, then by priority, count and order of appearance; None or 0: all."""
        key = F.col("priority") if "priority" in self.clusters.columns else F.lit(0)
        out = self.clusters.orderBy(F.desc(F.col("level") == "ERROR"), F.desc(key), F.desc("count"), "cluster_id")
        return out.limit(n) if n else out

    def verdict(self) -> dict:
        """Verdict, headline, candidates and gaps: a few rows each."""
        have = analysis.inventory(self.clusters, self.chains)
        told = analysis.verdict(self.clusters).first().asDict()
        missing = [r.code for r in analysis.gaps(have, self.stats.first().n_errors).collect()]
        first = [r.asDict() for r in analysis.candidates(self.clusters).select("cluster_id", "level", "module", "name", "count", "priority", "confidence", "reason", "first_line", "last_line").collect()]
        return told | {"gaps": missing, "candidates": first}

    def notice(self) -> str:
        """What a filter that leaves next to nothing has left out; empty for all others."""
        row = filters.notice(self.entries, self.options.filter).first()
        return row.text if row else ""


def run(lines: DataFrame, options: Options | None = None) -> Result:
    """Entries, clusters and, unless options say no, what they mean.  Each step is written and read back (a cut), so the plan
    of the next one stays small; reports then read tables."""
    o = options or Options()
    rule = rules.detect(source.sample(lines)) if o.rule == "auto" else o.rule
    if o.tail:
        lines = source.tail(lines, o.tail)
    if o.max_lines:
        lines = source.cap(lines, o.max_lines)
    every = cut(assemble.entries(lines, rule).filter(filters.in_time(o.filter)), "entries")
    held = cluster.members(cluster.with_template(every.filter(filters.matches(o.filter))), o.threshold)
    found = cut(cluster.clusters(held), "found")
    stats = cut(filters.stats(every), "stats")
    changes = cut(filters.changes(every), "changes")
    # chains are those of the entries that a report can show
    detailed = cut(cluster.detailed(held, found), "detailed")
    chains = cut(analysis.chains(detailed), "chains")
    if o.analyse:
        found = found.join(analysis.attach_traces(detailed, chains), "cluster_id", "left")
        found = _analysed(found, held, stats, changes, o)
    return Result(lines, every, held, held, found, stats, changes, analysis.traces(detailed), chains, o)


def _analysed(found: DataFrame, held: DataFrame, stats: DataFrame, changes: DataFrame, o: Options) -> DataFrame:
    found = found.withColumn("citable", evidence.citable(F.col("sample.line_no"), F.col("sample.next_start"), o.context, F.col("sample.last_line_no")))
    words = cut(analysis.cluster_tokens(found), "words")
    row = stats.first()
    k = 2.0 if o.deep else 3.0
    hist = cut(timeline.histogram(held, ("cluster_id",)), "hist")
    every = timeline.global_bursts(held, hist, k=k)
    bursts = timeline.own_bursts(hist, k=k).select("cluster_id").unionByName(every.select("cluster_id"))
    odd = cut(analysis.anomalies(found, cut(bursts, "bursts"), cut(timeline.periodic(held), "periodic"), words, row.n_errors, 5 if o.deep else 10), "anomalies")
    edges = cut(analysis.cross_edges(words, found), "edges")
    cited = held.withColumn("cited", evidence.citable(F.col("line_no"), F.col("next_start"), o.context, F.col("last_line_no")))
    causes = cut(cluster.causes(cited), "causes")
    roots = cut(analysis.root_causes(found, cut(analysis.keyword_scores(found), "scores"), edges, 2.0 if o.deep else analysis.STRONG, causes), "roots")
    out = cut(found.join(odd, "cluster_id").join(roots, "cluster_id"), "judged")
    context = analysis.change_context(found, changes).select("cluster_id", F.col("change").alias("change_context"))
    return cut(out.join(analysis.priorities(out, row.time_start, row.time_end), "cluster_id").join(context, "cluster_id", "left"), "analysed")


def analyze_files(spark: SparkSession, paths: list[str], options: Options | None = None) -> Result:
    return run(source.read_files(spark, paths), options)


def analyze_text(spark: SparkSession, text: str, options: Options | None = None) -> Result:
    return run(source.from_text(spark, text), options)


def compare_runs(a: Result, b: Result) -> DataFrame:
    return compare.ordered(compare.by_template(a.clusters.select("level", "template", "count"), b.clusters.select("level", "template", "count")))


def references(result: Result) -> DataFrame:
    """References to the samples of all clusters whose lines can be cited."""
    spans = result.members.groupBy("cluster_id").agg(F.min_by(F.struct("source", "file_line_no", "file_last_line_no"), F.struct(F.size("stack") == 0, "line_no")).alias("s"))
    ranges = spans.select(F.col("cluster_id").alias("key"), "s.source", F.col("s.file_line_no").alias("start_line"), F.col("s.file_last_line_no").alias("end_line"))
    return evidence.refs(result.lines, ranges)
