"""The registry of queries: each operator group applied to whole tables, with its DuckDB equivalent.

``events`` is read as a log (one entry an event), ``documents`` as log files (one a document), and
``conversations`` as traces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import levels, text, times
from emberlog.operators import analysis, assemble, cluster, compare, evidence, filters, rules, structured, timeline
from emberlog.sources import lines as source
from emberlog.sources.shared import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENT_LEVELS = {"error": "critical", "purchase": "Warning", "signup": "notice", "view": "debug:", "click": "[info]"}

# The log that events make, in DuckDB: e (raw level spelling in lv), then the entries.
_E = """WITH raw AS (SELECT event_id + 1 AS line_no, epoch_us(ts) / 1e6 AS ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'
 WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level, event_type AS module, 'user-' || user_id AS correlation_id,
 event_type || ' of user ' || user_id || CASE WHEN user_id % 3 = 0 THEN ' timed out, retrying' WHEN user_id % 3 = 1 THEN ' refused by peer' ELSE ' done' END
 || ' after ' || CAST(floor(value) AS BIGINT) || ' ms' AS message FROM events),
e AS (SELECT *, regexp_replace(regexp_replace(message, '\\b[0-9]+\\b', 'N', 'g'), '\\s+', ' ', 'g') AS template FROM raw),
c AS (SELECT row_number() OVER (ORDER BY min(line_no), level, template) AS cluster_id, level, template, min_by(message, line_no) AS summary, min_by(module, line_no) AS module,
 count(*) AS count, min(line_no) AS first_line, max(line_no) AS last_line, min_by(ts, line_no) AS first_seen, max_by(ts, line_no) AS last_seen FROM e GROUP BY level, template),
h AS (SELECT e.*, c.cluster_id FROM e JOIN c USING (level, template))
"""
# Token sets of clusters; the clusters are the heads of documents, of which many are alike.
_W = """WITH c AS (SELECT doc_id AS cluster_id, substr(text, 1, 160) AS summary, '' AS template, doc_id + 1 AS first_line FROM documents WHERE text IS NOT NULL), w AS (SELECT DISTINCT cluster_id, unnest(regexp_extract_all(lower(summary || ' ' || template), '[a-z_]{3,}')) AS token FROM c),
sz AS (SELECT cluster_id, count(*) AS size FROM w GROUP BY 1), df AS (SELECT token, count(*) AS df FROM w GROUP BY 1),
ov AS (SELECT a.cluster_id, b.cluster_id AS other, count(*) AS common, min(df.df) AS rarest, any_value(s1.size) AS size, any_value(s2.size) AS other_size
 FROM w a JOIN w b ON a.token = b.token AND a.cluster_id <> b.cluster_id JOIN df ON df.token = a.token JOIN sz s1 ON s1.cluster_id = a.cluster_id JOIN sz s2 ON s2.cluster_id = b.cluster_id GROUP BY 1, 2)
"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as entries: the same messages as in _E."""
    e = _t(spark, sf_dir, "events")
    tail = F.when(F.col("user_id") % 3 == 0, " timed out, retrying").when(F.col("user_id") % 3 == 1, " refused by peer").otherwise(" done")
    message = F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"), tail, F.lit(" after "), F.floor("value").cast("string"), F.lit(" ms"))
    spelled = F.element_at(levels.lookup(EVENT_LEVELS), F.col("event_type"))
    none = F.array().cast("array<string>")
    return e.select(
        (F.col("event_id") + 1).alias("line_no"), (F.col("event_id") + 1).alias("last_line_no"), (F.col("event_id") + 2).alias("next_start"), F.lit("events").alias("source"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), levels.normalize(spelled).alias("level"), F.col("event_type").alias("module"), message.alias("message"),
        message.alias("full_message"), none.alias("stack"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("correlation_id"),
    )


def event_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) of the event log, by exact templates."""
    held = cluster.members(cluster.with_template(event_log(spark, sf_dir)), threshold=0)
    return held, cluster.clusters(held)


def document_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's head as a cluster of its own."""
    d = _t(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select(F.col("doc_id").alias("cluster_id"), F.substring("text", 1, 160).alias("summary"), F.lit("").alias("template"), (F.col("doc_id") + 1).alias("first_line"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_column(_t(spark, sf_dir, "documents"), "doc_id", "text")


_L = "WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)\n"

# ------------------------------------------------------------------ sources


@query(_L + "SELECT source, CAST(n AS BIGINT) AS file_line_no, CAST(length(raw) AS BIGINT) AS chars FROM l")
def line_numbering(spark, sf_dir):
    return document_lines(spark, sf_dir).select("source", "file_line_no", F.length("raw").cast("long").alias("chars"))


@query(_L + ", m AS (SELECT source, max(n) AS m FROM l GROUP BY 1) SELECT l.source, CAST(n AS BIGINT) AS file_line_no FROM l JOIN m USING (source) WHERE n > m - 2")
def tail_lines(spark, sf_dir):
    return source.tail(document_lines(spark, sf_dir), 2).select("source", "file_line_no")


@query(_L + "SELECT source, CAST(n AS BIGINT) AS file_line_no FROM l WHERE n <= 3")
def max_lines_cap(spark, sf_dir):
    return source.cap(document_lines(spark, sf_dir), 3).select("source", "file_line_no")


@query(_L + ", m AS (SELECT source, max(n) AS m FROM l GROUP BY 1) SELECT l.source, CAST(n AS BIGINT) AS file_line_no FROM l JOIN m USING (source) WHERE m <= 6 OR n <= 2 OR (n > floor((m - 2) / 2) AND n <= floor((m - 2) / 2) + 2) OR n > m - 2")
def stratified_sample(spark, sf_dir):
    return source.sample(document_lines(spark, sf_dir), 6).select("source", "file_line_no")


@query(_L + "SELECT CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(raw) + 1) AS BIGINT) AS raw_chars FROM l")
def raw_char_count(spark, sf_dir):
    return source.raw_chars(document_lines(spark, sf_dir))


@query(_L + "SELECT source, CAST(count(*) FILTER (WHERE contains(raw, chr(0))) AS BIGINT) AS nul_lines, CAST(count(*) AS BIGINT) AS n_lines, count(*) FILTER (WHERE contains(raw, chr(0))) > 0 AS refused FROM l GROUP BY 1")
def binary_guard(spark, sf_dir):
    return source.binary_guard(document_lines(spark, sf_dir))


@query(_L + "SELECT source, CAST(n AS BIGINT) AS file_line_no, raw FROM l WHERE source = '7' AND n BETWEEN 1 AND 4")
def range_readback(spark, sf_dir):
    return source.read_range(document_lines(spark, sf_dir), "7", 1, 4).select("source", "file_line_no", "raw")


# ------------------------------------------------------------------ parsing

#: What \w, \s and \d are in Spark's patterns, for DuckDB, whose classes know ASCII alone.
_WORD, _SPACE, _NUMBER = r"\p{L}\p{M}\p{Nd}\p{Pc}", r"\t-\r\x{85}\p{Z}", r"\p{Nd}"


def _duck(pattern: str) -> str:
    """A pattern as a DuckDB literal: classes of all scripts, groups named DuckDB's way."""
    out, inside, k = "", False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        wide = {r"\w": _WORD, r"\s": _SPACE, r"\d": _NUMBER}.get(two)
        if two[0] == "\\":
            out += (wide if inside else f"[{wide}]") if wide else (rf"[^{_SPACE}]" if two == r"\S" else two)
            k += 2
            continue
        inside = two[0] == "[" or (inside and two[0] != "]")
        out += two[0]
        k += 1
    return "'" + out.replace("(?<", "(?P<").replace("'", "''") + "'"


def _any(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(raw, {_duck(p)})" for p in patterns) + ")"


def _redacted() -> str:
    """Redaction of x in DuckDB, which cannot look behind: addresses after a version's word are marked first, as part of a word."""
    *plain, (address, name) = text.REDACTIONS
    at = address.index(r"\b")
    out = "x"
    for pattern, said in plain:
        out = f"regexp_replace({out}, {_duck(pattern)}, '{said.replace('$', chr(92))}', 'g')"
    before = address[len("(?<!") : at - 1]
    out = f"regexp_replace({out}, {_duck(f'({before})' + address[at:].replace(chr(92) + 'b', '(', 1) + ')')}, '\\1zqvzqv\\2', 'g')"
    return f"replace(regexp_replace({out}, {_duck(address[at:])}, '{name}', 'g'), 'zqvzqv', '')"


_CLAIMS = "|".join(a.replace(".", r"\.") for m in ("level", "message", "error", "exception") for a in structured.ALIASES[m])
_KINDS = f""", k AS (SELECT *, regexp_matches(raw, '^[ \\t]') AS indented, {_any(rules.STACKS)} AS stack,
 (regexp_matches(raw, '^[A-Za-z_][A-Za-z0-9_.\\-]*=') AND regexp_matches(raw, '(?i)(^|[^A-Za-z0-9_])({_CLAIMS})=[^ ]') AND regexp_matches(raw, '=.* [A-Za-z_][A-Za-z0-9_.\\-]*='))
 OR (starts_with(ltrim(raw), chr(123)) AND json_valid(raw) AND regexp_matches(raw, '(?i)"({_CLAIMS})" *:')) AS claimed,
 {_any(p.replace("{LEVEL}", rules.LEVEL_WORDS) for _, p in rules.GENERIC)} AS known FROM l)
SELECT CASE WHEN regexp_matches(raw, '^[{_SPACE}]*$') THEN 'BLANK' WHEN claimed THEN 'START' WHEN indented THEN CASE WHEN stack THEN 'IND_STACK' ELSE 'IND_PLAIN' END
 WHEN regexp_matches(raw, {_duck(rules.FLUSH)}) THEN 'STACK' WHEN known THEN 'START' WHEN stack THEN 'STACK' ELSE 'START' END AS kind"""


@query(_L + _KINDS + ", CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1")
def line_kinds(spark, sf_dir):
    return assemble.classify(document_lines(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query(None)
def entry_assembly(spark, sf_dir):
    return assemble.entries(document_lines(spark, sf_dir)).select("source", "file_line_no", "file_last_line_no", "level", "module", F.size("stack").alias("n_stack"), F.size("message_extra").alias("n_extra"))


#: Lines of every kind: the lines of documents, each in a form that its place chooses.
_FORMS = ("{}", "\tat com.acme.Call.run(Call.java:7) {}", "Caused by: {}", "2024-01-02 03:04:05 ERROR [main] {}", " \t ", "    {}", 'level=info msg="ready" {}', "com.acme.BootError: {}", '  {{"level":"warn","message":"m"}}', "Backtrace: {}")


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = document_lines(spark, sf_dir)
    form = (F.col("source").cast("long") + F.col("file_line_no")) % len(_FORMS)
    made = F.coalesce(*(F.when(form == k, F.concat(F.lit(a), F.col("raw"), F.lit(b)) if "{}" in f else F.lit(f.format())) for k, f in enumerate(_FORMS) for a, _, b in [f.partition("{}")]))
    return l.withColumn("raw", made).withColumn("text", F.col("raw"))


_MADE = " ".join("WHEN " + str(k) + " THEN '" + (f.replace("{}", "' || raw || '") if "{}" in f else f.format()) + "'" for k, f in enumerate(_FORMS))
_MIXED = _L + f", p AS (SELECT source, doc_id, n, raw FROM l), q AS (SELECT source, n, CASE (doc_id + n) % {len(_FORMS)} {_MADE} END AS raw FROM p)" + _KINDS.replace("FROM l)", "FROM q)")


@query(_MIXED.replace("END AS kind", "END AS kind, source, CAST(n AS BIGINT) AS file_line_no") + " FROM k")
def line_kinds_mixed(spark, sf_dir):
    return assemble.classify(mixed_lines(spark, sf_dir)).select("kind", "source", "file_line_no")


@query(_MIXED.replace("SELECT CASE WHEN", ", j AS (SELECT CASE WHEN").replace("END AS kind", "END AS kind, source, n") + """ FROM k),
g AS (SELECT *, sum(CASE kind WHEN 'START' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY n) AS e FROM j WHERE kind <> 'BLANK'),
b AS (SELECT *, max(kind IN ('STACK', 'IND_STACK')) OVER (PARTITION BY source, e ORDER BY n) OR e = 0 AS stacky FROM g)
SELECT source, CAST(min(n) AS BIGINT) AS file_line_no, CAST(max(n) AS BIGINT) AS file_last_line_no, CAST(count(*) FILTER (WHERE kind <> 'START' AND stacky) AS BIGINT) AS n_stack,
 CAST(count(*) FILTER (WHERE kind <> 'START' AND NOT stacky) AS BIGINT) AS n_extra FROM b GROUP BY source, e""")
def entry_assembly_mixed(spark, sf_dir):
    e = assemble.entries(mixed_lines(spark, sf_dir))
    return e.select("source", "file_line_no", "file_last_line_no", F.size("stack").cast("long").alias("n_stack"), F.size("message_extra").cast("long").alias("n_extra"))


@query(_L + r"""SELECT source, CAST(count(*) FILTER (WHERE regexp_matches(raw, '^[ \t\r\f\v]*$')) AS BIGINT) AS blank, CAST(count(*) FILTER (WHERE regexp_matches(raw, '^[ \t]') AND NOT regexp_matches(raw, '^[ \t\r\f\v]*$')) AS BIGINT) AS indented FROM l GROUP BY 1""")
def blank_and_indented(spark, sf_dir):
    blank = F.col("raw").rlike(r"^[ \t\r\f\x0B]*$")
    return document_lines(spark, sf_dir).groupBy("source").agg(F.count_if(blank).alias("blank"), F.count_if(F.col("raw").rlike(r"^[ \t]") & ~blank).alias("indented"))


@query(_L + r"""SELECT source, CAST(n AS BIGINT) AS file_line_no, CASE WHEN regexp_matches(raw, '(?i)\b(ERROR|ERR|Exception)\b|uncaught') THEN 'ERROR' WHEN regexp_matches(raw, '(?i)\bFAIL(?:ED|URE|URES)?\b|\bASSERT(?:ION)?\b') THEN 'FAIL' WHEN regexp_matches(raw, '(?i)\bWARN(?:ING)?\b') THEN 'WARN' END AS level
FROM l WHERE regexp_matches(raw, '^[ -~]*$')""")
def level_inference(spark, sf_dir):
    l = document_lines(spark, sf_dir).filter(F.col("raw").rlike("^[ -~]*$"))
    return l.select("source", "file_line_no", rules.PRESETS["generic"].infer_level(F.col("raw")).alias("level"))


@query("""SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def level_normalize(spark, sf_dir):
    return event_log(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS iso, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS slashed, epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS day, CAST(946684800 + (epoch(date_trunc('second', ts)) % 86400) AS DOUBLE) AS clock FROM events""")
def timestamp_ladder(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    rows = _t(spark, sf_dir, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("a"), F.date_format(ts, "MM/dd/yyyy HH:mm:ss").alias("b"), F.date_format(ts, "yyyyMMdd").alias("c"), F.date_format(ts, "HH:mm:ss").alias("d"), ts.alias("ts"))
    return rows.select("event_id", times.show(F.unix_micros("ts") / 1e6).alias("shown"), times.parse(F.col("a")).alias("iso"), times.parse(F.col("b")).alias("slashed"), times.parse(F.col("c")).alias("day"), times.parse(F.col("d")).alias("clock"))


@query("""WITH j AS (SELECT event_id, json_keys(props) AS ks, props FROM events) SELECT event_id, CAST(len(ks) AS BIGINT) AS n_fields, json_extract_string(props, '$.' || '"' || list_sort(ks)[1] || '"') AS first_value FROM j""")
def json_field_pick(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", structured.json_fields(F.col("props")).alias("m"))
    return rows.select("event_id", F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("n_fields"), F.element_at("m", F.array_sort(F.map_keys("m"))[0]).alias("first_value"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level, 'user ' || user_id || ' did it' AS message, event_type AS module, 'u' || user_id AS trace_id FROM events""")
def logfmt_parse(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    spelled = F.element_at(levels.lookup({**EVENT_LEVELS, "view": "debug", "click": "info"}), F.col("event_type"))
    line = F.concat(F.lit("level="), spelled, F.lit(" logger="), "event_type", F.lit(' trace_id="u'), F.col("user_id").cast("string"), F.lit('" msg="user '), F.col("user_id").cast("string"), F.lit(' did" it'))
    out = structured.with_claim(e.select("event_id", line.alias("text")))
    return out.select("event_id", levels.normalize(F.col("claim.level")).alias("level"), F.col("claim.message").alias("message"), F.col("claim.module").alias("module"), F.col("claim.trace_id").alias("trace_id"))


@query(None)
def rule_scores(spark, sf_dir):
    return rules.scores(source.sample(document_lines(spark, sf_dir)))


# ------------------------------------------------------------------ filters


@query(_E + "SELECT level, CAST(count(*) AS BIGINT) AS n FROM e WHERE level IN ('ERROR', 'WARN') GROUP BY 1")
def level_filter(spark, sf_dir):
    return event_log(spark, sf_dir).filter(filters.matches(filters.Filter(levels=("ERROR", "WARN")))).groupBy("level").agg(F.count("*").alias("n"))


@query(_E + "SELECT line_no FROM e WHERE (contains(message, 'refused') OR contains(message, 'purchase')) AND NOT contains(message, 'signup')")
def keyword_filter(spark, sf_dir):
    return event_log(spark, sf_dir).filter(filters.matches(filters.Filter(levels=(), include=("Refused", "PURCHASE"), exclude=("signup",)))).select("line_no")


@query(_E + "SELECT line_no FROM e WHERE regexp_matches(message, '(?i)user 1[0-9] TIMED') AND NOT regexp_matches(message, 'click')")
def regex_filter(spark, sf_dir):
    return event_log(spark, sf_dir).filter(filters.matches(filters.Filter(levels=(), include_re=("user 1[0-9] TIMED",), exclude_re=("click",)))).select("line_no")


@query(_E + "SELECT line_no FROM e WHERE ts BETWEEN 1704672000 AND 1704931200")
def time_range_filter(spark, sf_dir):
    return event_log(spark, sf_dir).filter(filters.in_time(filters.Filter(start=1704672000.0, end=1704931200.0))).select("line_no")


@query(_E + "SELECT line_no FROM e WHERE floor(ts) % 86400 >= 82800 OR floor(ts) % 86400 <= 3600")
def tod_window_wrap(spark, sf_dir):
    return event_log(spark, sf_dir).filter(filters.in_time(filters.Filter(day_start=82800, day_end=3600))).select("line_no")


@query(_E + "SELECT CAST(count(*) AS BIGINT) AS n_entries, CAST(count(*) FILTER (WHERE level = 'ERROR') AS BIGINT) AS n_errors, min(ts) AS time_start, max(ts) AS time_end, CAST(count(ts) AS BIGINT) AS stamped FROM e")
def run_stats(spark, sf_dir):
    return filters.stats(event_log(spark, sf_dir)).drop("level_counts")


@query(_E + "SELECT cluster_id FROM c WHERE (contains(lower(summary || ' ' || module || ' ' || level || ' ' || template), 'refused') OR contains(lower(summary || ' ' || module || ' ' || level || ' ' || template), 'warn')) AND NOT contains(lower(summary || ' ' || module || ' ' || level || ' ' || template), 'click')")
def boolean_search(spark, sf_dir):
    return event_clusters(spark, sf_dir)[1].filter(filters.boolean("(refused or WARN) and not click")).select("cluster_id")


@query(_E + "SELECT line_no, substr(message, 1, 200) AS text FROM e WHERE module = 'view' AND FALSE")
def change_events(spark, sf_dir):
    return filters.changes(event_log(spark, sf_dir)).select("line_no", "text")


# ------------------------------------------------------------------ clusters


@query(_E + "SELECT level, template, CAST(count(*) AS BIGINT) AS count, min(line_no) AS first_line FROM e GROUP BY 1, 2")
def mask_template_counts(spark, sf_dir):
    return cluster.templates(cluster.with_template(event_log(spark, sf_dir)))


@query(_L + r""", m AS (SELECT trim(regexp_replace(regexp_replace(substr(raw, 1, 200), '\b[0-9]+\b', 'N', 'g'), '[ \t]+', ' ', 'g')) AS template FROM l WHERE regexp_matches(raw, '^[A-Za-z ,.]+[0-9 ]*[A-Za-z ,.]*$'))
SELECT template, CAST(count(*) AS BIGINT) AS count FROM m GROUP BY 1""")
def document_templates(spark, sf_dir):
    l = document_lines(spark, sf_dir).filter(F.col("raw").rlike("^[A-Za-z ,.]+[0-9 ]*[A-Za-z ,.]*$"))
    return l.groupBy(text.mask(F.col("raw")).alias("template")).agg(F.count("*").alias("count"))


@query(_E + "SELECT level, level || ' | ' || template AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1, 2")
def fingerprints(spark, sf_dir):
    return event_log(spark, sf_dir).groupBy("level", text.fingerprint(F.col("level"), F.col("full_message"), F.col("stack")).alias("fingerprint")).agg(F.count("*").alias("n"))


@query(_E + "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, level, template, substr(summary, 1, 160) AS summary, module, CAST(count AS BIGINT) AS count, first_line, last_line, first_seen, last_seen FROM c")
def cluster_summary(spark, sf_dir):
    return event_clusters(spark, sf_dir)[1].drop("sample").withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query(_E + "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, line_no, CAST(nth AS BIGINT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY line_no) AS nth FROM h) WHERE nth <= 2000")
def cluster_instances_capped(spark, sf_dir):
    return cluster.instances(event_clusters(spark, sf_dir)[0]).select(F.col("cluster_id").cast("long").alias("cluster_id"), "line_no", F.col("nth").cast("long").alias("nth"))


@query(_E + """, i AS (SELECT cluster_id, correlation_id, min(line_no) AS first_at FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY first_at, correlation_id) AS nth FROM i)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, correlation_id, CAST(nth AS BIGINT) AS nth FROM r WHERE nth <= 64""")
def cluster_trace_ids(spark, sf_dir):
    out = cluster.correlation_ids(event_clusters(spark, sf_dir)[0])
    return out.select(F.col("cluster_id").cast("long").alias("cluster_id"), "correlation_id", F.col("nth").cast("long").alias("nth"))


def _caused(spark, sf_dir):
    log = event_log(spark, sf_dir)
    stack = F.array(F.lit("\tat com.acme.Call.run(Call.java:7)"), F.concat(F.lit("Caused by: com.acme.Err"), (F.col("line_no") % 40).cast("string"), F.lit(": boom")), F.concat(F.lit("  caused by: root "), F.col("module"), (F.col("line_no") % 37).cast("string")))
    return cluster.members(cluster.with_template(log.withColumn("stack", F.when(F.col("level") == "ERROR", stack).otherwise(F.col("stack")))), threshold=0)


@query(_E + """, d AS (SELECT cluster_id, 'root ' || module || (line_no % 37) AS cause, count(*) AS count, min(line_no) AS first_line FROM h WHERE level = 'ERROR' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY first_line, cause) AS nth FROM d)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CASE WHEN nth <= 32 THEN cause END AS cause, CAST(sum(count) AS BIGINT) AS count, min(first_line) AS first_line FROM r GROUP BY 1, 2""")
def cause_counts_capped(spark, sf_dir):
    return cluster.causes(_caused(spark, sf_dir)).withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query(None)
def similarity_clusters(spark, sf_dir):
    """The event log by similar templates at the standard tier; tests/test_similarity.py holds it against a sequential reader."""
    held = cluster.members(cluster.with_template(event_log(spark, sf_dir)))
    return cluster.clusters(held).select(F.col("cluster_id").cast("long").alias("cluster_id"), "level", "template", "summary", "count", "first_line", "last_line")


@query(None)
def variable_distribution(spark, sf_dir):
    held, _ = event_clusters(spark, sf_dir)
    return cluster.slots(held)


# ------------------------------------------------------------------ time

_H = _E + """, sp AS (SELECT cluster_id, min(ts) AS origin, max(ts) - min(ts) AS span FROM h GROUP BY 1),
wd AS (SELECT cluster_id, origin, (SELECT min(8.0 ** k) FROM range(0, 13) AS r(k) WHERE floor(span / 8.0 ** k) < 96) AS width FROM sp),
hi AS (SELECT h.cluster_id, origin + floor((ts - origin) / width) * width AS t, width, count(*) AS n FROM h JOIN wd USING (cluster_id) GROUP BY 1, 2, 3)
"""


@query(_H + "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, t, width, CAST(n AS BIGINT) AS n FROM hi")
def time_histogram(spark, sf_dir):
    held, _ = event_clusters(spark, sf_dir)
    return timeline.histogram(held, ("cluster_id",)).withColumn("cluster_id", F.col("cluster_id").cast("long"))


_B = _H + """, md AS (SELECT *, median(n) OVER (PARTITION BY cluster_id) AS med, count(*) OVER (PARTITION BY cluster_id) AS b, max(n) OVER (PARTITION BY cluster_id) AS peak FROM hi),
ad AS (SELECT *, median(abs(n - med)) OVER (PARTITION BY cluster_id) AS mad FROM md), bu AS (SELECT *, greatest(med + 3 * 1.4826 * mad, 2 * med) AS lim FROM ad)
"""


@query(_B + "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, t, CAST(n AS BIGINT) AS n FROM bu WHERE b >= 2 AND n > lim")
def burst_buckets(spark, sf_dir):
    held, _ = event_clusters(spark, sf_dir)
    return timeline.bursts(timeline.histogram(held, ("cluster_id",)), ("cluster_id",)).select(F.col("cluster_id").cast("long").alias("cluster_id"), "t", "n")


@query(_B + "SELECT DISTINCT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(peak AS BIGINT) AS peak FROM bu WHERE b >= 3 AND peak >= 5 AND peak > lim")
def own_baseline_burst(spark, sf_dir):
    held, _ = event_clusters(spark, sf_dir)
    return timeline.own_bursts(timeline.histogram(held, ("cluster_id",))).select(F.col("cluster_id").cast("long").alias("cluster_id"), "peak")


@query(_E + """, s AS (SELECT correlation_id, ts - lag(ts) OVER (PARTITION BY correlation_id ORDER BY ts, line_no) AS d FROM h),
a AS (SELECT correlation_id, count(*) AS steps, avg(d) AS period, stddev_pop(d) / avg(d) AS cv FROM s WHERE d > 0.001 GROUP BY 1)
SELECT correlation_id, CAST(steps AS BIGINT) AS steps, round(period, 3) AS period, round(cv, 6) AS cv FROM a WHERE steps >= 3 AND cv <= 1.0""")
def periodic_clusters(spark, sf_dir):
    held, _ = event_clusters(spark, sf_dir)
    return timeline.periodic(held, "correlation_id", 1.0).select("correlation_id", "steps", F.round("period", 3).alias("period"), F.round("cv", 6).alias("cv"))


@query(_E + """SELECT CAST(a.cluster_id AS BIGINT) AS cluster_id, CAST(b.cluster_id AS BIGINT) AS other, CAST(count(*) AS BIGINT) AS hits FROM h a JOIN h b ON abs(a.ts - b.ts) <= 60 AND a.cluster_id <> b.cluster_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def cooccurrence(spark, sf_dir):
    held, _ = event_clusters(spark, sf_dir)
    return timeline.cooccurrence(held).select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("other").cast("long").alias("other"), "hits")


@query(_E + """, x AS (SELECT min(ts) AS lo, max(ts) AS hi FROM h), s AS (SELECT cluster_id, count(*) FILTER (WHERE ts BETWEEN 1704672000 AND 1704758400) AS inside, count(*) FILTER (WHERE NOT ts BETWEEN 1704672000 AND 1704758400) AS outside FROM h GROUP BY 1),
z AS (SELECT cluster_id, inside, outside / greatest(hi - lo - greatest(least(1704758400, hi) - greatest(1704672000, lo), 0), 1) * greatest(least(1704758400, hi) - greatest(1704672000, lo), 0) AS expected FROM s, x)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(inside AS BIGINT) AS inside, round(expected, 6) AS expected FROM z WHERE inside >= 2 AND (inside - expected) / sqrt(greatest(expected, 1)) >= 0.5""")
def window_surge(spark, sf_dir):
    held, _ = event_clusters(spark, sf_dir)
    return timeline.surge(held, 1704672000.0, 1704758400.0, z=0.5).select(F.col("cluster_id").cast("long").alias("cluster_id"), "inside", F.round("expected", 6).alias("expected"))


@query(_E + """, s AS (SELECT *, floor(first_seen / 60) AS slot FROM c), r AS (SELECT *, count(*) OVER (PARTITION BY slot) AS held, row_number() OVER (PARTITION BY slot ORDER BY first_seen, first_line) AS nth FROM s)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(held AS BIGINT) AS held FROM r WHERE held >= 2 AND nth = 1""")
def window_first_error(spark, sf_dir):
    return timeline.first_in_window(event_clusters(spark, sf_dir)[1]).select(F.col("cluster_id").cast("long").alias("cluster_id"), "held")


# ------------------------------------------------------------------ analysis

_ROOTS = ", ".join(f"('{w}', 'root')" for w in analysis.ROOT) + ", " + ", ".join(f"('{w}', 'cascade')" for w in analysis.CASCADE)
_KW = _E + f""", kw(word, kind) AS (VALUES {_ROOTS}), hit AS (SELECT cluster_id, word, kind FROM c, kw WHERE contains(lower(summary || ' ' || template), word)),
wt AS (SELECT word, kind, count(DISTINCT cluster_id) AS df, log2(1 + (SELECT count(*) FROM c) / count(DISTINCT cluster_id)) AS weight FROM hit GROUP BY 1, 2)
"""


@query(_KW + "SELECT word, kind, CAST(df AS BIGINT) AS df, round(weight, 6) AS weight FROM wt")
def keyword_idf(spark, sf_dir):
    return analysis.keyword_weights(event_clusters(spark, sf_dir)[1]).withColumn("weight", F.round("weight", 6))


@query(_KW + "SELECT CAST(c.cluster_id AS BIGINT) AS cluster_id, round(coalesce(sum(CASE wt.kind WHEN 'root' THEN weight ELSE -weight END), 0), 6) AS score FROM c LEFT JOIN hit USING (cluster_id) LEFT JOIN wt USING (word, kind) GROUP BY 1")
def keyword_score(spark, sf_dir):
    return analysis.keyword_scores(event_clusters(spark, sf_dir)[1]).select(F.col("cluster_id").cast("long").alias("cluster_id"), F.round("score", 6).alias("score"))


@query(_E + """, p AS (SELECT a.cluster_id, max_by(b.cluster_id, (b.last_line, -b.cluster_id)) AS prior, a.first_line - max(b.last_line) AS gap FROM c a JOIN c b ON b.first_line < a.first_line GROUP BY a.cluster_id, a.first_line)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(prior AS BIGINT) AS prior, CAST(gap AS BIGINT) AS gap FROM p""")
def nearest_prior(spark, sf_dir):
    out = analysis.nearest_prior(event_clusters(spark, sf_dir)[1])
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("cluster_id", "prior", "gap")))


@query(_W + "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(other AS BIGINT) AS other, round(common / (size + other_size - common), 6) AS jaccard FROM ov WHERE common / (size + other_size - common) >= 0.8")
def related_clusters(spark, sf_dir):
    out = analysis.related(analysis.cluster_tokens(document_heads(spark, sf_dir)))
    return out.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("other").cast("long").alias("other"), F.round("jaccard", 6).alias("jaccard"))


@query(_W + "SELECT DISTINCT CAST(cluster_id AS BIGINT) AS cluster_id FROM w WHERE cluster_id NOT IN (SELECT cluster_id FROM ov WHERE common / (size + other_size - common) >= 0.5)")
def novel_clusters(spark, sf_dir):
    return analysis.novel(analysis.cluster_tokens(document_heads(spark, sf_dir))).select(F.col("cluster_id").cast("long").alias("cluster_id"))


_X = _W + ", ed AS (SELECT ov.other AS source, ov.cluster_id AS target FROM ov JOIN c a ON a.cluster_id = ov.cluster_id JOIN c b ON b.cluster_id = ov.other WHERE b.first_line < a.first_line AND ov.size >= 2 AND common / ov.size >= 0.6 AND (common = ov.size OR rarest <= 2))\n"


@query(_X + "SELECT CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target FROM ed")
def cross_reference_edges(spark, sf_dir):
    c = document_heads(spark, sf_dir)
    return analysis.cross_edges(analysis.cluster_tokens(c), c).select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))


@query(_X + "SELECT CAST(source AS BIGINT) AS cluster_id, CAST(count(*) AS BIGINT) AS out_degree FROM ed WHERE source NOT IN (SELECT target FROM ed) GROUP BY 1")
def graph_sources(spark, sf_dir):
    c = document_heads(spark, sf_dir)
    return analysis.reference_sources(analysis.cluster_tokens(c), c).select(F.col("cluster_id").cast("long").alias("cluster_id"), "out_degree")


@query(_E + """, ev AS (SELECT line_no, ts FROM e WHERE module = 'signup' ORDER BY line_no LIMIT 200), nr AS (SELECT c.cluster_id, max_by(ev.line_no, (ev.ts, ev.line_no)) AS change_line, c.first_seen - max(ev.ts) AS gap FROM c JOIN ev ON ev.ts < c.first_seen AND c.first_seen - ev.ts <= 1800 AND ev.line_no <> c.first_line GROUP BY c.cluster_id, c.first_seen)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, change_line, round(gap, 3) AS gap FROM nr""")
def change_context(spark, sf_dir):
    log = event_log(spark, sf_dir).filter("module = 'signup'").select("line_no", "ts", F.col("message").alias("text")).orderBy("line_no").limit(filters.MAX_CHANGES)
    out = analysis.change_context(event_clusters(spark, sf_dir)[1], log)
    return out.select(F.col("cluster_id").cast("long").alias("cluster_id"), "change_line", F.round("gap", 3).alias("gap"))


@query("""WITH s AS (SELECT 'conv-' || conv_id AS correlation_id, count(*) AS n_steps, count(DISTINCT role) AS n_modules, string_agg(role, '>' ORDER BY turn, role) AS path FROM (SELECT DISTINCT * FROM conversations) GROUP BY 1)
SELECT correlation_id, CAST(n_steps AS BIGINT) AS n_steps, CAST(n_modules AS BIGINT) AS n_modules, path FROM s WHERE n_steps >= 2 AND n_modules >= 2 ORDER BY n_steps DESC, correlation_id LIMIT 20""")
def trace_chains(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").distinct()
    log = c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("correlation_id"), F.col("turn").cast("double").alias("ts"), F.col("turn").alias("line_no"), F.col("role").alias("module"), F.lit("INFO").alias("level"), F.col("text").alias("message"))
    return analysis.traces(log).select("correlation_id", "n_steps", "n_modules", F.array_join(F.transform("steps", lambda s: s["module"]), ">").alias("path"))


def _analysed(spark, sf_dir):
    held, c = event_clusters(spark, sf_dir)
    c = cut(c, "found")
    words = cut(analysis.cluster_tokens(c), "words")
    found = analysis.anomalies(c, timeline.own_bursts(timeline.histogram(held, ("cluster_id",))), timeline.periodic(held), words, 100)
    roots = analysis.root_causes(c, cut(analysis.keyword_scores(c), "scores"), cut(analysis.cross_edges(words, c), "edges"))
    return c.join(found, "cluster_id").join(roots, "cluster_id")


@query(None)
def root_causes(spark, sf_dir):
    return _analysed(spark, sf_dir).select("cluster_id", "anomaly", "is_root_cause", "confidence", "reason")


@query(_E + """, x AS (SELECT min(ts) AS a, max(ts) AS b FROM e), s AS (SELECT c.*, 35 * CASE level WHEN 'ERROR' THEN 0.95 WHEN 'FAIL' THEN 0.75 WHEN 'WARN' THEN 0.45 WHEN 'INFO' THEN 0.20 WHEN 'DEBUG' THEN 0.08 ELSE 0.03 END
 + 25 * log10(count + 1) / log10((SELECT max(count) FROM c) + 1) + 20 * (count % 2) + CASE WHEN x.b - last_seen BETWEEN 0 AND 60 THEN 5 ELSE 0 END + CASE WHEN first_seen >= x.a + 0.75 * (x.b - x.a) THEN 5 ELSE 0 END AS score FROM c, x),
p AS (SELECT cluster_id, round(CASE WHEN level = 'ERROR' THEN greatest(score, 80) WHEN level = 'WARN' THEN CASE WHEN score < 35 THEN 35 WHEN score >= 55 THEN 54.9 ELSE score END WHEN level = 'INFO' THEN CASE WHEN score < 15 THEN 15 WHEN score >= 35 THEN 34.9 ELSE score END ELSE CASE WHEN score >= 15 THEN 14.9 ELSE score END END, 1) AS priority FROM s)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(priority AS DOUBLE) AS priority, CASE WHEN priority >= 75 THEN 'P0' WHEN priority >= 55 THEN 'P1' WHEN priority >= 35 THEN 'P2' WHEN priority >= 15 THEN 'P3' ELSE 'P4' END AS label FROM p""")
def priority_score(spark, sf_dir):
    log = event_log(spark, sf_dir)
    _, c = event_clusters(spark, sf_dir)
    ends = filters.stats(log).first()
    c = c.withColumn("is_root_cause", F.col("count") % 2 == 1).withColumn("anomaly", F.lit(None).cast("string"))
    return analysis.priorities(c, ends.time_start, ends.time_end).withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query(_E + "SELECT cluster_id, count FROM (SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(count AS BIGINT) AS count FROM c ORDER BY level = 'ERROR' DESC, count DESC, cluster_id LIMIT 10)")
def topn_clusters(spark, sf_dir):
    c = event_clusters(spark, sf_dir)[1]
    return c.orderBy(F.desc(F.col("level") == "ERROR"), F.desc("count"), "cluster_id").limit(10).select(F.col("cluster_id").cast("long").alias("cluster_id"), "count")


@query(_E + "SELECT module, CAST(sum(count) AS BIGINT) AS n FROM c GROUP BY 1 ORDER BY n DESC, module LIMIT 10")
def module_distribution(spark, sf_dir):
    return event_clusters(spark, sf_dir)[1].groupBy("module").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "module").limit(10)


@query(_E + "SELECT CAST(count(*) AS BIGINT) AS clusters, TRUE AS timestamps, FALSE AS stacks, CAST(count(DISTINCT module) AS BIGINT) AS modules, CAST(count(DISTINCT level) AS BIGINT) AS levels FROM c")
def gap_inventory(spark, sf_dir):
    c = event_clusters(spark, sf_dir)[1].withColumn("confidence", F.lit("")).withColumn("priority", F.lit(0.0))
    return analysis.inventory(c).select("clusters", "timestamps", "stacks", "modules", "levels")


# The ladder of root causes over the clusters of _caused: errors name causes, all else is inferred.
_LADDER = _KW + """, np AS (SELECT a.cluster_id, max_by(b.cluster_id, (b.last_line, -b.cluster_id)) AS prior FROM c a JOIN c b ON b.first_line < a.first_line GROUP BY a.cluster_id),
w AS (SELECT DISTINCT cluster_id, unnest(regexp_extract_all(lower(substr(summary, 1, 160) || ' ' || template), '[a-z_]{3,}')) AS token FROM c),
sz AS (SELECT cluster_id, count(*) AS size FROM w GROUP BY 1), df AS (SELECT token, count(*) AS df FROM w GROUP BY 1),
ov AS (SELECT a.cluster_id, b.cluster_id AS other, count(*) AS common, min(df.df) AS rarest, any_value(sz.size) AS size FROM w a JOIN w b ON a.token = b.token AND a.cluster_id <> b.cluster_id JOIN df ON df.token = a.token JOIN sz ON sz.cluster_id = a.cluster_id GROUP BY 1, 2),
ed AS (SELECT ov.other AS source, ov.cluster_id AS target FROM ov JOIN c a ON a.cluster_id = ov.cluster_id JOIN c b ON b.cluster_id = ov.other WHERE b.first_line < a.first_line AND ov.size >= 2 AND common / ov.size >= 0.6 AND (common = ov.size OR rarest <= 2)
 UNION SELECT prior, cluster_id FROM np JOIN c USING (cluster_id) WHERE level = 'ERROR'),
ca AS (SELECT cluster_id, 'root ' || module || (line_no % 37) AS cause, count(*) AS n, min(line_no) AS first_at FROM h WHERE level = 'ERROR' GROUP BY 1, 2),
cr AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY first_at, cause) AS nth, sum(n) OVER (PARTITION BY cluster_id) AS total FROM ca),
tp AS (SELECT cluster_id, min_by(cause, (-n, cause)) AS top, max(n) AS top_count, count(*) AS kinds, any_value(total) AS total FROM cr WHERE nth <= 32 GROUP BY 1),
sc AS (SELECT c.cluster_id, coalesce(sum(CASE wt.kind WHEN 'root' THEN weight ELSE -weight END), 0) AS score, coalesce(bool_or(hit.kind = 'cascade'), FALSE) AS passive FROM c LEFT JOIN hit USING (cluster_id) LEFT JOIN wt USING (word, kind) GROUP BY 1),
fw AS (SELECT cluster_id, floor(first_seen / 60) AS slot, count(*) OVER (PARTITION BY floor(first_seen / 60)) AS crowd, row_number() OVER (PARTITION BY floor(first_seen / 60) ORDER BY first_seen, first_line) AS nth FROM c),
lk AS (SELECT c.*, score, passive, top, top_count, kinds, total, CASE WHEN fw.nth = 1 THEN slot END AS slot, crowd, (SELECT count(*) FROM ed WHERE source = c.cluster_id) AS n_out,
 (SELECT min_by(u.summary, (u.first_seen, u.first_line)) FROM ed JOIN c u ON u.cluster_id = ed.source WHERE ed.target = c.cluster_id) AS up FROM c JOIN sc USING (cluster_id) LEFT JOIN tp USING (cluster_id) LEFT JOIN fw USING (cluster_id)),
op AS (SELECT *, top IS NULL AND NOT (n_out > 0 AND up IS NULL) AND slot IS NOT NULL AND score > 0 AS opens FROM lk),
la AS (SELECT *, CASE WHEN top IS NOT NULL THEN 'CONFIRMED' WHEN (n_out > 0 AND up IS NULL) OR opens OR score >= 3 THEN 'LIKELY' ELSE 'INSUFFICIENT' END AS confidence,
 CASE WHEN top IS NOT NULL THEN 'cause named in the entry: ' || top || CASE WHEN kinds > 1 THEN ' (one of ' || kinds || ' causes, ' || top_count || ' of ' || total || ' times)' ELSE '' END
  WHEN n_out > 0 AND up IS NULL THEN 'source of the graph: ' || n_out || ' clusters derive from it' WHEN opens AND slot > (SELECT min(slot) FROM op WHERE opens) THEN 'earliest of a later window, with words of a cause'
  WHEN opens AND crowd = 1 THEN 'alone in its window, with words of a cause' WHEN opens THEN 'earliest of the first window, with words of a cause' WHEN score >= 3 THEN 'words of a cause'
  WHEN up IS NOT NULL THEN 'seems to derive from: ' || substr(up, 1, 40) WHEN passive THEN 'words of a consequence' ELSE 'no evidence of its own' END AS reason FROM op)
"""


def _ladder(spark, sf_dir):
    """(members, clusters with their verdicts) of the log whose errors name causes."""
    held = _caused(spark, sf_dir)
    c = cut(cluster.clusters(held), "found")
    edges = cut(analysis.cross_edges(analysis.cluster_tokens(c), c), "edges")
    scores, causes = cut(analysis.keyword_scores(c), "scores"), cut(cluster.causes(held.withColumn("cited", F.lit(True))), "causes")
    return held, cut(c.join(analysis.root_causes(c, scores, edges, causes=causes), "cluster_id"), "judged")


@query(_LADDER + "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, confidence, confidence <> 'INSUFFICIENT' AS is_root_cause, reason, coalesce(top, substr(summary, 1, 160)) AS name FROM la")
def root_cause_ladder(spark, sf_dir):
    return _ladder(spark, sf_dir)[1].select(F.col("cluster_id").cast("long").alias("cluster_id"), "confidence", "is_root_cause", "reason", "name")


# Chains of the event log: ids of users are long enough from two digits on.
_CH = """, ch AS (SELECT correlation_id, count(*) AS n_steps, count(DISTINCT module) AS n_modules FROM h WHERE length(correlation_id) BETWEEN 6 AND 64 GROUP BY 1 HAVING count(*) >= 2 AND (count(DISTINCT module) >= 2 OR bool_or(level IN ('ERROR', 'FAIL'))))
"""


@query(_E + _CH + """, p AS (SELECT DISTINCT cluster_id, correlation_id FROM h JOIN ch USING (correlation_id)), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY correlation_id) AS nth FROM p)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, string_agg(correlation_id, ',' ORDER BY correlation_id) AS traces FROM r WHERE nth <= 8 GROUP BY 1""")
def trace_attachment(spark, sf_dir):
    held, _ = event_clusters(spark, sf_dir)
    out = analysis.attach_traces(held, analysis.chains(held))
    return out.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.array_join("traces", ",").alias("traces"))


@query(_LADDER + _CH + """, g AS (SELECT (SELECT count(*) FROM la WHERE confidence = 'CONFIRMED') AS sure, (SELECT count(DISTINCT module) FROM la WHERE module <> 'error') AS modules, (SELECT count(*) FROM ch) AS chains,
 (SELECT count(*) FROM la WHERE confidence = 'LIKELY' AND (SELECT max(count) FROM la WHERE confidence = 'LIKELY') - count < 5) AS close)
SELECT code, CAST(weight AS INT) AS weight FROM (SELECT 'no_causal_chain' AS code, 100 AS weight, (SELECT count(*) FROM la WHERE module <> 'error' AND confidence = 'CONFIRMED') = 0 AS x
 UNION ALL SELECT 'ambiguous_candidates', 90, (SELECT count(*) FROM la WHERE module <> 'error' AND confidence = 'LIKELY' AND (SELECT max(count) FROM la WHERE module <> 'error' AND confidence = 'LIKELY') - count < 5) > 1
 UNION ALL SELECT 'single_module', 80, modules <= 1 FROM g UNION ALL SELECT 'no_correlation_id', 75, chains = 0 FROM g UNION ALL SELECT 'no_stacks', 60, TRUE) WHERE x""")
def evidence_gaps(spark, sf_dir):
    held, c = _ladder(spark, sf_dir)
    rest = c.filter("module <> 'error'").withColumn("priority", F.col("count").cast("double"))
    return analysis.gaps(analysis.inventory(rest, analysis.chains(held)), 0)


@query(_LADDER + "SELECT 'CONFIRMED' AS verdict, TRUE AS can_conclude, 'Root cause: ' || substr(top, 1, 60) || ' (named in the entry, line ' || first_line || ')' AS headline FROM la WHERE confidence = 'CONFIRMED' ORDER BY count DESC, cluster_id LIMIT 1")
def verdict_headline(spark, sf_dir):
    return analysis.verdict(_ladder(spark, sf_dir)[1].withColumn("priority", F.lit(0.0)))


@query(_E + """, b AS (SELECT *, level = 'ERROR' AND contains(message, 'refused') AS keep FROM e), l AS (SELECT level, count(*) AS n FROM b GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE keep) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE NOT keep AND module = 'purchase') AS BIGINT) AS causal_dropped, (SELECT string_agg(level || ' ' || n, ' / ' ORDER BY n DESC, level) FROM l) AS levels
FROM b HAVING count(*) >= 50 AND count(*) FILTER (WHERE keep) <= 0.15 * count(*)""")
def filter_notice(spark, sf_dir):
    stack = F.when(F.col("module") == "purchase", F.array(F.lit("Caused by: com.acme.DownError: no route"))).otherwise(F.col("stack"))
    out = filters.notice(event_log(spark, sf_dir).withColumn("stack", stack), filters.Filter(levels=("ERROR",), include=("refused",)))
    return out.select("total", "kept", "causal_dropped", F.array_join(F.transform("level_counts", lambda v: F.concat_ws(" ", v["level"], v["n"].cast("string"))), " / ").alias("levels"))


# The event log with all errors in one minute.
_FLOOD = "CASE event_type WHEN 'error' THEN 1704672000.0::DOUBLE + event_id % 60 ELSE epoch_us(ts) / 1e6 END AS ts"


@query(_H.replace("epoch_us(ts) / 1e6 AS ts", _FLOOD) + """, gs AS (SELECT min(ts) AS origin, max(ts) - min(ts) AS span FROM h), gw AS (SELECT origin, (SELECT min(8.0 ** k) FROM range(0, 13) AS r(k) WHERE floor(span / 8.0 ** k) < 512) AS step FROM gs),
gh AS (SELECT CAST(floor((ts - origin) / step) AS BIGINT) AS slot, count(*) AS n FROM h, gw GROUP BY 1), gm AS (SELECT *, median(n) OVER () AS med, count(*) OVER () AS b FROM gh),
ga AS (SELECT *, median(abs(n - med)) OVER () AS mad FROM gm), hot AS (SELECT slot FROM ga WHERE b >= 2 AND n > greatest(med + 3 * 1.4826 * mad, 2 * med)),
pk AS (SELECT cluster_id, min_by(t, (-n, t)) AS peak_t FROM hi GROUP BY 1)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, peak_t FROM pk, gw WHERE CAST(floor((peak_t - origin) / step) AS BIGINT) IN (SELECT slot FROM hot)""")
def global_burst_clusters(spark, sf_dir):
    ts = F.when(F.col("module") == "error", 1704672000.0 + (F.col("line_no") - 1) % 60).otherwise(F.col("ts"))
    held = cluster.members(cluster.with_template(event_log(spark, sf_dir).withColumn("ts", ts)), threshold=0)
    return timeline.global_bursts(held, timeline.histogram(held, ("cluster_id",))).withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query(_E + "SELECT line_no, 'service restarted by user ' || user_no AS text FROM (SELECT line_no, module, substr(correlation_id, 6) AS user_no FROM e) WHERE module = 'signup' ORDER BY line_no LIMIT 200")
def change_events_found(spark, sf_dir):
    said = F.when(F.col("module") == "signup", F.concat(F.lit("service restarted by user "), F.substr("correlation_id", F.lit(6)))).otherwise(F.col("full_message"))
    return filters.changes(event_log(spark, sf_dir).withColumn("full_message", said)).select("line_no", "text")


@query(_E + """, s AS (SELECT *, floor(first_seen / 60) AS slot FROM c), r AS (SELECT *, count(*) OVER (PARTITION BY slot) AS held, row_number() OVER (PARTITION BY slot ORDER BY first_seen, first_line) AS nth FROM s)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(held AS BIGINT) AS held FROM r WHERE nth = 1""")
def window_earliest(spark, sf_dir):
    return timeline.first_in_window(event_clusters(spark, sf_dir)[1], least=1).select(F.col("cluster_id").cast("long").alias("cluster_id"), "held")


@query(_E + r""", x AS (SELECT DISTINCT template, unnest(string_split_regex(regexp_replace(template, '\b0xH\b|\b[USHPN]\b', ' ', 'g'), '\s+')) AS token FROM e) SELECT template, string_agg(token, ' ' ORDER BY token) AS tokens FROM x WHERE token <> '' GROUP BY 1""")
def template_literals(spark, sf_dir):
    found = cluster.templates(cluster.with_template(event_log(spark, sf_dir))).select("template").distinct()
    return found.select("template", F.array_join(cluster.literal_tokens(F.col("template")), " ").alias("tokens"))


@query(_E + "SELECT level, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1 ORDER BY n DESC, level")
def level_distribution(spark, sf_dir):
    return cluster.distribution(event_clusters(spark, sf_dir)[1], "level", None)


@query(_E + "SELECT CAST(cluster_id AS BIGINT) AS cluster_id FROM c WHERE module = 'purchase' AND level = 'WARN'")
def cluster_lookup(spark, sf_dir):
    return cluster.lookup(event_clusters(spark, sf_dir)[1], module="purchase", level="warn").select(F.col("cluster_id").cast("long").alias("cluster_id"))


# ------------------------------------------------------------------ evidence, comparison, reports

_R = _L + ", r AS (SELECT source, 1 AS start_line, max(n) AS end_line FROM l GROUP BY 1), d AS (SELECT r.source, start_line, end_line, sha256(string_agg(rtrim(raw, chr(13)), chr(10) ORDER BY n)) AS sha256 FROM r JOIN l ON l.source = r.source AND n BETWEEN start_line AND end_line GROUP BY 1, 2, 3)\n"


def _ranges(l: DataFrame) -> DataFrame:
    return l.groupBy("source").agg(F.max("file_line_no").alias("end_line")).select(F.col("source").alias("key"), "source", F.lit(1).cast("long").alias("start_line"), "end_line")


@query(_R + "SELECT source, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, sha256, substr(sha256(concat_ws('|', source, start_line, end_line, 'entry', sha256)), 1, 12) AS ref_id FROM d")
def evidence_digest(spark, sf_dir):
    l = document_lines(spark, sf_dir)
    return evidence.refs(l, _ranges(l)).select("source", "start_line", "end_line", "sha256", "ref_id")


@query(_R + """SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN CAST(source AS BIGINT) % 10 = 0 THEN 'MISSING_SOURCE' WHEN CAST(source AS BIGINT) % 10 = 1 THEN 'MISMATCH' WHEN CAST(source AS BIGINT) % 10 = 2 THEN 'OUT_OF_RANGE' ELSE 'MATCH' END AS status FROM d) GROUP BY 1""")
def evidence_verify(spark, sf_dir):
    l = document_lines(spark, sf_dir)
    kind = F.col("source").cast("long") % 10
    refs = evidence.refs(l, _ranges(l)).withColumn("k", kind)
    refs = refs.withColumn("end_line", F.when(F.col("k") == 2, F.lit(1 << 40)).otherwise(F.col("end_line")))
    refs = refs.withColumn("sha256", F.when(F.col("k") == 1, F.lit("0")).otherwise(F.col("sha256"))).withColumn("source", F.when(F.col("k") == 0, F.concat(F.lit("gone-"), "source")).otherwise(F.col("source")))
    refs = refs.filter("end_line < 1000000").unionByName(refs.filter("end_line >= 1000000").withColumn("end_line", F.lit(1 << 20)))
    return evidence.verify(refs, l).groupBy("status").agg(F.count("*").alias("n"))


@query(_R + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS matched, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS unknown, 'VERIFIED' AS verdict FROM d")
def evidence_verdict(spark, sf_dir):
    l = document_lines(spark, sf_dir)
    return evidence.verdict(evidence.verify(evidence.refs(l, _ranges(l)), l))


@query(_L + """, m AS (SELECT source, max(n) AS file_lines FROM l GROUP BY 1) SELECT source, CAST(file_lines AS BIGINT) AS file_lines, CAST(file_lines + CAST(source AS BIGINT) % 3 - 1 AS BIGINT) AS last_line FROM m
WHERE (CAST(source AS BIGINT) % 3 = 2) OR (file_lines + CAST(source AS BIGINT) % 3 - 1 < 1)""")
def display_ranges(spark, sf_dir):
    l = document_lines(spark, sf_dir)
    shown = _ranges(l).select("source", F.col("start_line").alias("first_line"), (F.col("end_line") + F.col("source").cast("long") % 3 - 1).alias("last_line"))
    gone = shown.limit(1).select(F.lit("not there").alias("source"), "first_line", "last_line")
    return evidence.out_of_file(shown.unionByName(gone), l).select("source", "file_lines", "last_line")


@query(_L + """, g AS (SELECT source, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY doc_id, n) AS line_no FROM l), k AS (SELECT *, (line_no - 1) // 100 AS key FROM g), t AS (SELECT key FROM k GROUP BY 1 HAVING count(*) = 100)
SELECT CAST(key AS BIGINT) AS key, source, min(n) AS start_line, max(n) AS end_line FROM k JOIN t USING (key) GROUP BY 1, 2""")
def ranges_by_file(spark, sf_dir):
    rows = source.consecutive(document_lines(spark, sf_dir))
    keys = rows.select(F.floor((F.col("line_no") - 1) / 100).alias("key")).distinct()
    spans = keys.select("key", (F.col("key") * 100 + 1).alias("first"), (F.col("key") * 100 + 100).alias("last"))
    return evidence.split_ranges(rows, spans).select("key", "source", "start_line", "end_line")


@query(_E + """, s AS (SELECT cluster_id AS key, min(line_no) AS p FROM h GROUP BY 1), b AS (SELECT key, 'before' AS side, greatest(p - 5, p + 1 - 69, 1) AS lo, p - 1 AS hi FROM s UNION ALL SELECT key, 'after', p + 1, p + 5 FROM s)
SELECT CAST(key AS BIGINT) AS key, side, CAST(line_no AS BIGINT) AS line_no FROM b JOIN raw ON line_no BETWEEN lo AND hi""")
def context_before_after(spark, sf_dir):
    held, c = event_clusters(spark, sf_dir)
    samples = c.select(F.col("cluster_id").cast("long").alias("key"), F.col("sample.line_no").alias("line_no"), F.col("sample.next_start").alias("next_start"))
    return evidence.context(event_log(spark, sf_dir).select("line_no", F.col("message").alias("text")), samples, 5).select("key", "side", "line_no")


def _runs(spark, sf_dir):
    log = cluster.with_template(event_log(spark, sf_dir))
    a = cluster.templates(log.filter("ts < 1705000000 AND correlation_id < 'user-7'"))
    return a, cluster.templates(log.filter("ts >= 1705000000 AND module <> 'signup'"))


_D = _E + """, a AS (SELECT level, template, count(*) AS count_a FROM e WHERE ts < 1705000000 AND correlation_id < 'user-7' GROUP BY 1, 2), b AS (SELECT level, template, count(*) AS count_b FROM e WHERE ts >= 1705000000 AND module <> 'signup' GROUP BY 1, 2),
cmp AS (SELECT coalesce(a.level, b.level) AS level, coalesce(a.template, b.template) AS template, CASE WHEN count_a IS NULL THEN 'new' WHEN count_b IS NULL THEN 'gone' ELSE 'common' END AS status, CAST(coalesce(count_a, 0) AS BIGINT) AS count_a, CAST(coalesce(count_b, 0) AS BIGINT) AS count_b,
 round(100.0 * (count_b - count_a) / count_a, 6) AS change FROM a FULL JOIN b ON a.level = b.level AND a.template = b.template)
"""


@query(_D + "SELECT * FROM cmp")
def compare_runs(spark, sf_dir):
    return compare.by_template(*_runs(spark, sf_dir)).withColumn("change", F.round("change", 6))


@query(_D + "SELECT level, template, count_b FROM cmp WHERE status = 'new'")
def new_errors(spark, sf_dir):
    return compare.by_template(*_runs(spark, sf_dir)).filter("status = 'new'").select("level", "template", "count_b")


@query(_D + "SELECT level, template, count_a FROM cmp WHERE status = 'gone'")
def gone_errors(spark, sf_dir):
    return compare.by_template(*_runs(spark, sf_dir)).filter("status = 'gone'").select("level", "template", "count_a")


@query(_E + """, a AS (SELECT DISTINCT level, template FROM e WHERE ts < 1705000000 AND module <> 'purchase') SELECT level, template, CAST(count(*) AS BIGINT) AS count_b FROM e ANTI JOIN a USING (level, template) WHERE ts >= 1705000000 GROUP BY 1, 2""")
def new_kinds(spark, sf_dir):
    log = cluster.with_template(event_log(spark, sf_dir))
    before, after = log.filter("ts < 1705000000 AND module <> 'purchase'"), log.filter("ts >= 1705000000")
    return compare.by_template(cluster.templates(before), cluster.templates(after)).filter("status = 'new'").select("level", "template", "count_b")


@query(f"SELECT doc_id, {_redacted()} AS text FROM (SELECT doc_id, text AS x FROM documents)")
def redact_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


@query(_E + "SELECT line_no, CAST(greatest(1, round_even(length(message) / 4, 0)) AS BIGINT) AS tokens FROM e")
def token_estimate(spark, sf_dir):
    return event_log(spark, sf_dir).select("line_no", text.token_estimate(F.col("message")).alias("tokens"))


@query(_E + """, g AS (SELECT cluster_id, line_no - lag(line_no) OVER (PARTITION BY cluster_id ORDER BY line_no) AS gap FROM h), m AS (SELECT cluster_id, median(gap) AS med, count(gap) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT CAST(g.cluster_id AS BIGINT) AS cluster_id, CAST(any_value(med) AS DOUBLE) AS median_gap, 2 * count(*) FILTER (WHERE gap BETWEEN 0.5 * med AND 2 * med) >= any_value(n) AS even FROM g JOIN m USING (cluster_id) WHERE gap IS NOT NULL GROUP BY 1""")
def instance_density(spark, sf_dir):
    from pyspark.sql import Window

    held, _ = event_clusters(spark, sf_dir)
    gap = F.col("line_no") - F.lag("line_no").over(Window.partitionBy("cluster_id").orderBy("line_no"))
    gaps = held.select("cluster_id", gap.alias("gap")).filter("gap IS NOT NULL")
    med = gaps.groupBy("cluster_id").agg(F.median("gap").alias("median_gap"), F.count("*").alias("n"))
    near = F.col("gap").between(0.5 * F.col("median_gap"), 2 * F.col("median_gap"))
    out = gaps.join(med, "cluster_id").groupBy("cluster_id").agg(F.first("median_gap").alias("median_gap"), (2 * F.count_if(near) >= F.first("n")).alias("even"))
    return out.withColumn("cluster_id", F.col("cluster_id").cast("long"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What distinct errors are in the log: errors by template, with counts and range, most frequent first."""
    kept = event_log(spark, sf_dir).filter(filters.matches(filters.Filter()))
    held = cluster.members(cluster.with_template(kept), threshold=0)
    return cluster.clusters(held).drop("sample").orderBy(F.desc("count"), "cluster_id")


@query(_E + ", f AS (SELECT * FROM c WHERE level = 'ERROR') SELECT CAST(row_number() OVER (ORDER BY first_line, level, template) AS BIGINT) AS cluster_id, level, template, substr(summary, 1, 160) AS summary, module, CAST(count AS BIGINT) AS count, first_line, last_line, first_seen, last_seen FROM f")
def distinct_errors(spark, sf_dir):
    return flagship(spark, sf_dir).withColumn("cluster_id", F.col("cluster_id").cast("long"))


# ------------------------------------------------------------------ a whole log file, from raw lines on


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the lines of one log file: a head for each, stacks under errors, continued messages under purchases."""
    e = _t(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    word = F.element_at(levels.lookup({"error": "FATAL", "purchase": "WARN", "signup": "INFO", "view": "DEBUG", "click": "INFO"}), F.col("event_type"))
    head = F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), word, F.lit(" ["), "event_type", F.lit("] user "), F.col("user_id").cast("string"), F.lit(" waited "), F.floor("value").cast("string"))
    more = F.when(F.col("event_type") == "error", F.array(F.lit("\tat com.acme.Call.run(Call.java:7)"), F.lit("Caused by: com.acme.DownError: no route"), F.lit("    12 more"))).when(F.col("event_type") == "purchase", F.array(F.lit("  and paid"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    rows = e.select("event_id", F.posexplode(F.concat(F.array(head), more)).alias("k", "raw"))
    sizes = e.select("event_id", (1 + F.size(more)).alias("n"))
    from pyspark.sql import Window

    # a running sum over blocks of events, then within each: no single task orders all lines
    block = F.floor(F.col("event_id") / 4096)
    totals = sizes.groupBy(block.alias("block")).agg(F.sum("n").alias("n"))
    bases = totals.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.sum("n").over(Window.partitionBy("block").orderBy("event_id")) - F.col("n")
    starts = sizes.withColumn("block", block).withColumn("within", within).join(bases, "block").select("event_id", (F.col("base") + F.col("within")).alias("start"))
    no = (F.col("start") + F.col("k") + 1).cast("long")
    return rows.join(starts, "event_id").select(F.lit("app.log").alias("source"), F.lit(0).alias("file_seq"), no.alias("file_line_no"), no.alias("line_no"), "raw", F.col("raw").alias("text"))


_LOG = """WITH z AS (SELECT *, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 1 END AS n FROM events),
s AS (SELECT *, 1 + sum(n) OVER (ORDER BY event_id) - n AS line_no FROM z),
en AS (SELECT CAST(line_no AS BIGINT) AS line_no, CAST(line_no + CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS last_line_no, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
 event_type AS module, 'user ' || user_id || ' waited ' || CAST(floor(value) AS BIGINT) AS message, floor(epoch_us(ts) / 1000) / 1000 AS ts, CAST(CASE event_type WHEN 'error' THEN 3 ELSE 0 END AS BIGINT) AS n_stack, CAST(CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS n_extra FROM s)
"""


@query(_LOG + "SELECT line_no, last_line_no, level, module, message, round(ts, 3) AS ts, n_stack, n_extra FROM en")
def log_entries(spark, sf_dir):
    e = assemble.entries(raw_log(spark, sf_dir))
    return e.select("line_no", "last_line_no", "level", "module", "message", F.round("ts", 3).alias("ts"), F.size("stack").cast("long").alias("n_stack"), F.size("message_extra").cast("long").alias("n_extra"))


@query(_LOG + "SELECT level, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE level = 'ERROR') AS BIGINT) AS with_cause, CASE WHEN level = 'ERROR' THEN 'com.acme.DownError: no route' ELSE '' END AS cause FROM en GROUP BY 1")
def deepest_cause(spark, sf_dir):
    e = assemble.entries(raw_log(spark, sf_dir))
    lines = text.causal_lines(F.col("stack"), F.col("message"))
    return e.select("level", text.deepest_cause(lines).alias("cause"), text.has_cause(lines).alias("has")).groupBy("level", "cause").agg(F.count("*").alias("n"), F.count_if("has").alias("with_cause"))


@query(_LOG + "SELECT CAST(count(*) AS BIGINT) AS n, 'com.acme.DownError: no route' AS cause, TRUE AS confirmed FROM en WHERE level = 'ERROR'")
def confirmed_causes(spark, sf_dir):
    e = cluster.with_template(assemble.entries(raw_log(spark, sf_dir)).filter("level = 'ERROR'"))
    c = cut(cluster.clusters(cluster.members(e, threshold=0)), "found")
    none = c.select(F.col("cluster_id").alias("source"), F.col("cluster_id").alias("target")).limit(0)
    roots = analysis.root_causes(c, c.select("cluster_id", F.lit(0.0).alias("score")), none)
    return c.join(roots, "cluster_id").groupBy("cause").agg(F.sum("count").alias("n"), F.min(F.col("confidence") == "CONFIRMED").alias("confirmed"))


@query(_LOG + "SELECT CAST(2 AS BIGINT) AS business, CAST(0 AS BIGINT) AS noise, CAST(count(*) AS BIGINT) AS n FROM en WHERE level = 'ERROR' HAVING count(*) > 0")
def stack_fold(spark, sf_dir):
    e = assemble.entries(raw_log(spark, sf_dir)).filter("level = 'ERROR'").withColumn("f", text.fold_stack(F.slice("stack", 1, 2)))
    return e.groupBy(F.col("f.business").cast("long").alias("business"), F.col("f.noise").cast("long").alias("noise")).agg(F.count("*").alias("n"))
