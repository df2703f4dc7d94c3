"""Column functions over message texts: masks, fingerprints, causes, redaction, estimates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is masked in a message, in this order, and by what.
MASKS = (
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "U"),
    (r"\b(?=[0-9a-fA-F]{6,16}\b)(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{6,16}\b", "H"),
    (r"\b0[xX][0-9a-fA-F]+\b", "0xH"),
    (r"'[^']*'|\"[^\"]*\"", "S"),
    (r"(?:[A-Za-z]:[\\/]|(?<![\w.\-])(?:\.{1,2})?[\\/][\w.\-/\\]*|(?<![\w.\-])[\w\-]+(?:[\\/][\w\-]+)*[\\/][\w\-]+\.[A-Za-z0-9]{1,8}(?![\w.\-]))", "P"),
    (r"\b\d+(?:\.\d+)?\b", "N"),
)
MESSAGE_CHARS, FRAME_CHARS, SUMMARY_CHARS = 200, 120, 160

# What is redacted on the way out, in this order.
REDACTIONS = (
    (r"(?i)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 [SECRET]"),
    (r"(?i)\b(token|api[_-]?key|secret|password|passwd|authorization|access[_-]?key)\s*[:=]\s*['\"]?[^\s,'\"]+", "$1=[SECRET]"),
    (r"\b([a-zA-Z][a-zA-Z0-9+.-]*://)[^/\s:@]+(?::[^/\s@]*)?@", "$1[CRED]@"),
    (r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", "[EMAIL]"),
    (r"\b1[3-9]\d{9}\b", "[PHONE]"),
    (r"(?<!(?i:version|ver|release|版本|版本号)\s{0,4}[:=]?\s{0,4})\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?\b", "[IP]"),
)

CAUSED_BY = r"(?i)^\s*Caused by\s*[:：]\s*(.+?)\s*$"
CAUSED_INLINE = r"(?i)Caused by\s*[:：]\s*([A-Za-z_][\w.$]*(?:Exception|Error|Throwable|Fault)[^\n]*)"

ANSI = r"\x1b\[[0-9;?]*[A-Za-z]"

# Frames of runtimes, libraries and frameworks.
NOISE_FRAMES = (
    r"site-packages", r"dist-packages", r"/lib/python\d", r"<frozen importlib", r"\bimportlib\._bootstrap", r"\basyncio\base_events",
    r"\bsocketserver\.py", r"\bthreading\.py", r"\bssl\.py", r"\.venv/", r"virtualenv",
    r"^\s*at\s+(java|jdk|sun|javax|com\.sun)\.", r"java\.base@", r"java\.lang\.", r"sun\.reflect", r"org\.springframework\.",
    r"org\.apache\.(tomcat|catalina|kafka|http|logging)", r"io\.netty\.", r"org\.hibernate\.", r"com\.google\.common",
    r"com\.fasterxml\.jackson", r"ch\.qos\.logback", r"org\.slf4j", r"node_modules", r"webpack:", r"babel[\\/.]",
    r"at System\.", r"at Microsoft\.", r"C:\\Windows[\\/]", r"Microsoft\.NET\\", r"libc\.so", r"libstdc\+\+", r"ld-linux",
    r"/usr/lib/", r"/usr/local/lib/", r"/lib/x86_64",
)


#: All characters with Unicode's property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(WHITE))


def strip_ansi(x: Column) -> Column:
    return F.when(x.contains("\x1b"), F.regexp_replace(x, ANSI, "")).otherwise(x)


def mask(text: Column, limit: int = MESSAGE_CHARS) -> Column:
    """A message with its parameters masked: what entries of one kind have in common."""
    out = F.substring(text, 1, limit)
    for pattern, name in MASKS:
        out = F.regexp_replace(out, f"(?U){pattern}", name)
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def fingerprint(level: Column, message: Column, stack: Column) -> Column:
    """Level, masked message and the first three masked frames; empty parts left out."""
    frames = F.transform(F.slice(stack, 1, 3), lambda x: mask(x, FRAME_CHARS))
    parts = F.concat(F.array(level, mask(message)), F.coalesce(frames, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: p != ""), " | ")


def cause_of(line: Column) -> Column:
    """The exception that a line names after Caused by, or null."""
    whole, inline = F.regexp_extract(line, CAUSED_BY, 1), F.regexp_extract(line, CAUSED_INLINE, 1)
    return F.when(whole != "", strip(whole)).when(inline != "", strip(inline))


def causal_lines(stack: Column, message: Column) -> Column:
    return F.concat(F.coalesce(stack, F.array().cast("array<string>")), F.when(F.coalesce(message, F.lit("")) != "", F.array(message)).otherwise(F.array().cast("array<string>")))


def has_cause(lines: Column) -> Column:
    return F.exists(lines, lambda x: x.rlike(r"(?i)^\s*Caused by\s*[:：]") | x.rlike(CAUSED_INLINE))


def deepest_cause(lines: Column) -> Column:
    """The last cause that the lines name: the innermost; an empty string if there is none."""
    found = F.filter(F.transform(lines, cause_of), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def is_noise(frame: Column) -> Column:
    return frame.rlike("(?i)" + "|".join(NOISE_FRAMES))


def fold_stack(stack: Column) -> Column:
    """struct(lines, business, noise): runs of noise frames become one line that counts them."""

    def step(acc: Column, line: Column) -> Column:
        key = line.rlike(r"(?i)^\s*Caused by\s*[:：]") | line.rlike(r"^[A-Za-z_][\w.$]*(Exception|Error|Fault)\b")
        noise = is_noise(line) & ~key
        note = F.format_string("    ... %d frames of libraries", acc["run"])
        flushed = F.when(acc["run"] > 0, F.array_append(acc["lines"], note)).otherwise(acc["lines"])
        return F.when(noise, F.struct(acc["lines"].alias("lines"), (acc["run"] + 1).alias("run"), acc["business"].alias("business"), (acc["noise"] + 1).alias("noise"))).otherwise(F.struct(F.array_append(flushed, line).alias("lines"), F.lit(0).alias("run"), (acc["business"] + 1).alias("business"), acc["noise"].alias("noise")))

    def finish(acc: Column) -> Column:
        note = F.format_string("    ... %d frames of libraries", acc["run"])
        return F.struct(F.when(acc["run"] > 0, F.array_append(acc["lines"], note)).otherwise(acc["lines"]).alias("lines"), acc["business"].alias("business"), acc["noise"].alias("noise"))

    begin = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(0).alias("run"), F.lit(0).alias("business"), F.lit(0).alias("noise"))
    return F.aggregate(stack, begin, step, finish)


def redact(text: Column, custom: tuple[str, ...] = ()) -> Column:
    """Secrets, addresses and numbers of people masked.  A custom pattern that does not compile rejects all."""
    for pattern in custom:
        re.compile(pattern)
    out = text
    for pattern, name in REDACTIONS:
        out = F.regexp_replace(out, f"(?U){pattern}", name)
    for pattern in custom:
        out = F.regexp_replace(out, pattern, "[CUSTOM]")
    return out


def tokens(text: Column) -> Column:
    """The set of words of three letters or more, or runs of two CJK characters or more, lower-case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z_]{3,}|[\x{4e00}-\x{9fff}]{2,}"), F.lit(0)))


def token_estimate(text: Column) -> Column:
    """About how many model tokens a text has: a quarter of its narrow characters, two thirds of its wide ones."""
    narrow = F.length(F.regexp_replace(text, r"[\x{2E80}-\x{10FFFF}]", ""))
    return F.greatest(F.lit(1), F.bround(narrow / 4 + (F.length(text) - narrow) / 1.5)).cast("long")


def ratio_text(before: Column, after: Column) -> Column:
    """A saving in words of per cent that never rounds up to everything."""
    share = 100.0 * (before - after) / before
    return F.when(before <= 0, F.lit("n/a")).when(share <= 0, F.lit("0%")).when(share >= 99.95, F.lit(">99.9%")).when(share >= 99.5, F.concat(F.format_number(share, 1), F.lit("%"))).otherwise(F.concat(F.bround(share).cast("int").cast("string"), F.lit("%")))
