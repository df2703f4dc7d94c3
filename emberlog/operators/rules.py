"""Rule sets: what a line of a format looks like, as column expressions.

A pattern's named groups are timestamp, level, module and message; the first pattern that
matches a line wins.  (No pattern is tried first because it matched the line before:
lines are judged one by one, so partitioning cannot change a result.)
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import levels, times
from emberlog.functions.text import strip

# The words a level may be written as, and the formats of the three presets.
LEVEL_WORDS = "TRACE|DEBUG|INFO|NOTICE|NOTE|WARNING|WARN|ERROR|ERR|SEVERE|FATAL|CRITICAL|CRIT|PANIC|EMERG|ALERT|FAILURE|FAILED|FAIL|EXCEPTION|ASSERTION|ASSERT"
_ISO = r"(?<timestamp>\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?(?:\s*(?:Z|[+-]\d{2}:?\d{2}))?)"
_BRACKET_ISO = ("bracket_iso", r"(?i)^\[" + _ISO + r"\]\s*(?:(?<level>{LEVEL})\s*[:\-]\s+)?(?<message>.*)$")
GENERIC = (
    ("android_logcat", r"^(?<timestamp>\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[.,]\d{3})\s+\d+\s+\d+\s+(?<level>[VDIWEFS])\s+(?<module>[^:\n]{1,64}?)\s*:\s*(?<message>.*)$"),
    _BRACKET_ISO,
    ("iso_level_module", "^" + _ISO + r"\s*[\[(]?\s*(?<level>{LEVEL})\s*[\])]?:?\s*(?:[\[(](?<module>[^()\]]{1,64})[)\]]\s*)?(?:[-:>|—]\s*)?(?<message>.*)$"),
    ("iso_dash_level_module", "^" + _ISO + r"\s*[-–—]\s*(?<level>{LEVEL})\s*(?:[\[(](?<module>(?:[^\[\]]|\[[^\]]*\]){1,96})[)\]])?\s*(?:[-:>|—]\s*)?(?<message>.*)$"),
    ("pipe_delimited_device", r"^(?<timestamp>\d{8}-\d{2}:\d{2}:\d{2}(?::\d{1,6})?)\|(?<module>[^|\r\n]{1,64})\|(?:[^|\r\n]*\|)*(?<message>[^|\r\n]*)$"),
    ("iso_level_icase", "(?i)^" + _ISO + r"\s*(?<level>{LEVEL})\s*[:\-\|]\s*(?<message>.*)$"),
    ("time_level_module", r"^(?<timestamp>\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,6})?)\s*(?:\[(?<module>[^\]]{1,64})\]\s*)?[\[(]?\s*(?<level>{LEVEL})\s*[\])]?:?\s*(?<message>.*)$"),
    ("level_first", r"^[\[(]?\s*(?<level>{LEVEL})\s*[\])]?\s*[:\-\|]?\s*(?<message>\S.*)$"),
    ("gcc_style", r"(?i)^(?<module>\S+\.(?:c|h|cc|cpp|cxx|hpp|hh)):(?<lineno>\d+)(?::\d+)?\s*:\s*(?:(?<level>fatal error|error|warning|note)\s*:\s*)?(?<message>.*)$"),
    ("syslog", r"^(?<timestamp>[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?<module>[\w.\-/]+)(?:\[\d+\])?:?\s*(?<message>.*)$"),
)
EMBEDDED = (
    ("bracket_ts_level_module", r"^\[\s*(?<timestamp>\d+(?:\.\d+)?)\s*\]\s*\[\s*(?<level>[A-Za-z]{1,10})\s*\]\s*(?:\[(?<module>[^\]]{1,64})\]\s*)?(?<message>.*)$"),
    _BRACKET_ISO,
    ("time_level_ut", r"^(?<timestamp>\d{2}:\d{2}:\d{2}(?:[.,]\d{1,3})?)\s+[\[(]?\s*(?<level>{LEVEL}|PASS|OK)\s*[\])]?\s*[:\-]?\s*(?<message>.*)$"),
    ("gcc_style", r"(?i)^(?<module>\S+\.(?:c|h|cc|cpp|cxx|hpp|hh)):(?<lineno>\d+)(?::\d+)?\s*:\s*(?:(?<level>fatal error|error|warning|note|FAIL(?:ED|URE)?|ASSERT)\s*[:\s]*)?(?<message>.*)$"),
    ("module_level_colon", r"^(?<module>[A-Za-z_][\w.\-]{0,63})\s+(?<timestamp>\d{2}:\d{2}:\d{2}(?:[.,]\d{1,3})?)\s*[\[(]?\s*(?<level>{LEVEL}|PASS)\s*[\])]?\s*[:\-]?\s*(?<message>.*)$"),
    ("level_first", r"^[\[(]?\s*(?<level>{LEVEL}|PASS|OK)\s*[\])]?\s*[:\-\|]?\s*(?<message>\S.*)$"),
)
JENKINS = (
    ("ts_channel_message", r"^(?:\[(?<timestamp>\d{4}-\d{2}-\d{2}T[\d:.]+Z?)\]\s*)?(?:\[(?:out|err|info|debug|echo|hpi)\]\s*)?(?<message>\S.*)$"),
    ("maven_level", r"^[\[(]\s*(?<level>ERROR|WARNING|WARN|SEVERE|INFO)\s*[\])]\s*[:\-]?\s*(?<message>\S.*)$"),
    ("gradle_style", r"^(?<message>\S.*)$"),
)
STACKS = (r"^\s*at\s+[\w$.]+\(", r"^\s*Caused by\s*:?", r"^Traceback \(most recent call last\)", r'^\s*File\s+"[^"]+".*,\s*line\s+\d+', r"^\s*raise\s+\w", r"^Backtrace:", r"^\s*~?\$?\s*0x[0-9a-fA-F]{4,}\s*<", r"^[A-Za-z_][\w.$]*(?:Exception|Error|Fault|Interrupt)\s*[:({]")
EMBEDDED_STACKS = (*STACKS, r"^\s*#\d+\s+0x[0-9a-fA-F]+", r"^.*\bat\s+[\w]+:\d+\s*$")
JENKINS_STACKS = (*STACKS[:5], r"^FAILURE: Build failed", r"^\s*\.\.\.\s*\d+\s*more\b", STACKS[7])
HINTS = {"ERROR": [r"\bERROR\b", r"\bERR\b", r"\bException\b", "uncaught"], "FAIL": [r"\bFAIL(?:ED|URE|URES)?\b", r"\bASSERT(?:ION)?\b"], "WARN": [r"\bWARN(?:ING)?\b"]}
EMBEDDED_HINTS = {"ERROR": [r"\bHARDFAULT\b", r"\bMEMFAULT\b", r"\bBUSFAULT\b", r"\bWatchdog\b", r"\bstack overflow\b", r"\bassert(?:ion)? failed\b", r"\bERROR\b", r"\bERR\b", r"\bException\b"], "FAIL": [r"\bFAIL(?:ED|URE)?\b", r"\bASSERT(?:ION)?\b", r"\bPASS\b.*\bnot\b"], "WARN": [r"\bWARN(?:ING)?\b"]}
JENKINS_HINTS = {"ERROR": ["BUILD ABORTED", "OUT OF MEMORY", "JVM terminated", "fatal error", r"\[err\]", r"\[severe\]", r"\[ERROR\]", r"\bERROR\b", "Compilation error", r"\bException\b", "Could not"], "FAIL": ["BUILD FAILURE", r"\bFAILED\b", r"\bfailures?\b", "There are test failures", r"Tests run:.*(?:Failures|Errors): *[1-9]"], "WARN": [r"\[warning\]", r"\bWARNING\b"]}
#: A stack line that is not indented begins with one of these, or names an exception.
FLUSH = r"^(Caused by|Traceback|Backtrace|at |File |raise |terminate)|^[A-Za-z_][\w.$]*(?:Exception|Error|Fault|Interrupt)\s*[:({]"

MARK = "\x01"
GROUPS = ("timestamp", "level", "module", "message")


@dataclass(frozen=True)
class RuleSet:
    name: str
    patterns: tuple[tuple[str, str], ...]
    stacks: tuple[str, ...] = STACKS
    hints: dict = field(default_factory=lambda: HINTS, hash=False)

    def __post_init__(self) -> None:
        for name, pattern in self.patterns:
            groups = set(re.findall(r"\(\?<([a-z]+)>", pattern))
            if not groups & set(GROUPS):
                raise ValueError(f"pattern {name} of {self.name} names none of {GROUPS}")

    def with_match(self, df: DataFrame, text: str = "text", name: str = "m") -> DataFrame:
        """df with struct(pattern, timestamp, level, module, message) of the first pattern that matches, or null."""
        tries = []
        for label, raw in self.patterns:
            pattern = "(?U)" + raw.replace("{LEVEL}", LEVEL_WORDS)
            has = set(re.findall(r"\(\?<([a-z]+)>", pattern))
            groups = MARK.join("${" + g + "}" if g in has else "" for g in GROUPS)
            tries.append(F.when(F.col(text).rlike(pattern), F.regexp_replace(text, pattern, f"{label}{MARK}{groups}")))
        out = df.withColumn(name, F.split(F.coalesce(*tries), MARK))
        got = lambda k: F.nullif(F.col(name)[k], F.lit(""))
        return out.withColumn(name, F.when(F.col(name).isNotNull(), F.struct(F.col(name)[0].alias("pattern"), *(got(k + 1).alias(g) for k, g in enumerate(GROUPS)))))

    def is_stack(self, text: Column) -> Column:
        return text.rlike("(?U)" + "|".join(self.stacks))

    def infer_level(self, text: Column) -> Column:
        return levels.infer(text, self.hints)


PRESETS = {"generic": RuleSet("generic", GENERIC), "embedded": RuleSet("embedded", EMBEDDED, EMBEDDED_STACKS, EMBEDDED_HINTS), "jenkins": RuleSet("jenkins", JENKINS, JENKINS_STACKS, JENKINS_HINTS)}


def load(rule: str | RuleSet | None) -> RuleSet:
    """A preset by name, a YAML file by path, a rule set as it is; None: generic."""
    if rule is None:
        return PRESETS["generic"]
    if isinstance(rule, RuleSet):
        return rule
    if rule in PRESETS:
        return PRESETS[rule]
    import yaml

    with open(rule, encoding="utf-8") as f:
        body = yaml.safe_load(f)
    flags = {"i": "(?i)", "ignorecase": "(?i)", "m": "(?m)", "multiline": "(?m)"}
    patterns = []
    for p in body["patterns"]:
        text = p["regex"].replace("(?P<", "(?<").replace("(?P=", r"\k<").replace("{LEVEL}", LEVEL_WORDS)
        re.compile(p["regex"].replace("{LEVEL}", LEVEL_WORDS))
        patterns.append((p.get("name", "unnamed"), "".join(flags[f] for f in p.get("flags", [])) + text))
    return RuleSet(body.get("name", rule), tuple(patterns), tuple(body.get("stack_indicators", STACKS)), body.get("level_hints", HINTS))


def scores(sample: DataFrame) -> DataFrame:
    """Per preset the shares of a sample's lines that hit, have a timestamp, have a module."""
    rows = sample.filter(strip(F.col("text")) != "").select("text")
    for name, rules in PRESETS.items():
        rows = rules.with_match(rows, "text", f"m_{name}").withColumn(f"r_{name}", F.col(f"m_{name}.timestamp"))
        rows = rows.withColumn(f"t_{name}", times.parse(F.col(f"r_{name}")).isNotNull())
    rate = lambda flag: F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("double")), F.lit(0.0))
    aggs = []
    for name in PRESETS:
        m, stamped = F.col(f"m_{name}"), F.col(f"t_{name}")
        aggs.append(F.struct(F.lit(name).alias("rule"), rate(stamped | m["level"].isNotNull() | m["module"].isNotNull()).alias("hits"), rate(stamped).alias("stamps"), rate(m["module"].isNotNull()).alias("modules")))
    return rows.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("x")).select("x.*")


def detect(sample: DataFrame) -> str:
    """The preset with the best hit rate, then timestamp rate, then module rate; the first of equals."""
    rows = scores(sample).collect()
    best = max(rows, key=lambda r: (r.hits, r.stamps, r.modules, -list(PRESETS).index(r.rule)))
    return best.rule if best.hits > 0 else "generic"
