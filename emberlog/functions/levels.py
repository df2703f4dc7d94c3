"""Levels: a closed, ordered domain, its spellings and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of levels, their weights, and other spellings.
ORDER = ("ERROR", "FAIL", "WARN", "INFO", "DEBUG", "TRACE")
WEIGHTS = {"ERROR": 0.95, "FAIL": 0.75, "WARN": 0.45, "INFO": 0.20, "DEBUG": 0.08, "TRACE": 0.03}
ERRORS = ("ERROR", "FAIL")
ALIASES = {
    "WARNING": "WARN", "ERR": "ERROR", "FATAL": "ERROR", "SEVERE": "ERROR", "CRITICAL": "ERROR", "CRIT": "ERROR",
    "PANIC": "ERROR", "EMERG": "ERROR", "ALERT": "ERROR", "FAILED": "FAIL", "FAILURE": "FAIL", "ASSERT": "FAIL",
    "ASSERTION": "FAIL", "EXCEPTION": "ERROR", "NOTICE": "INFO", "NOTE": "INFO", "PASS": "INFO", "FATAL ERROR": "ERROR",
    "E": "ERROR", "W": "WARN", "I": "INFO", "D": "DEBUG", "T": "TRACE",
}


def lookup(table: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def canonical(raw: Column) -> Column:
    """The level that a spelling stands for, or null."""
    token = F.upper(F.regexp_replace(F.regexp_replace(raw, r"^[ \t\[\]():\-|>]+|[ \t\[\]():\-|>]+$", ""), r"(?U)^\s+|\s+$", ""))
    return F.element_at(lookup({**ALIASES, **{x: x for x in ORDER}}), token)


def normalize(raw: Column) -> Column:
    """The level that a spelling stands for; what is not known counts as INFO."""
    return F.coalesce(canonical(raw), F.lit("INFO"))


def weight(level: Column) -> Column:
    return F.coalesce(F.element_at(lookup(WEIGHTS), level), F.lit(0.5))


def infer(text: Column, hints: dict[str, list[str]]) -> Column:
    """The first level in the order ERROR, FAIL, WARN of which a hint is in the text, or null."""
    tests = [F.when(text.rlike("(?iU)" + "|".join(hints[k])), F.lit(k)) for k in ("ERROR", "FAIL", "WARN") if hints.get(k)]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")
