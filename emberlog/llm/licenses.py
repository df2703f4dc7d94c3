"""License scan: exact phrases, and fuzzy search of short notices.

A notice of L characters may differ by up to (L + 1) // 12 edits.  Cut into one piece more than
edits, at least one piece must stand unchanged (pigeonhole), so an automaton over the
pieces of all notices gives the places worth a look, and the regex library's
bounded-error matching decides there on every stretch of whole words, within the widest
window the edits allow.  A fuzzy match begins and ends at word bounds of the normalised text:
lower-case words joined by single spaces.  Of overlapping matches of a notice the one with
the fewest edits stands, then the leftmost, then the shortest.

Cases: a null or empty text has no words, no match and score 0; repeated rows are
scanned alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberlog.llm.textnum import slices

# Fixed phrases and labels of the base.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Short notices that the fuzzy search looks for, and their labels.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("boost software license", "bsl"),
    ("all rights reserved", "proprietary"),
)

EDIT_EVERY = 12


def allowed(notice: str) -> int:
    return (len(notice) + 1) // EDIT_EVERY


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice cut into one piece more than its edits: (offset, piece)."""
    n = allowed(notice) + 1
    bounds = [round(k * len(notice) / n) for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(bounds, bounds[1:])]


@functools.lru_cache(maxsize=4)
def _compiled(notices: tuple[tuple[str, str], ...]):
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    for k, (notice, _) in enumerate(notices):
        for at, piece in pieces(notice):
            seeds.setdefault(piece, []).append((k, at))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    return automaton, [regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={allowed(notice)}}}") for notice, _ in notices]


# A-Z to a-z; every ASCII byte that is no letter or digit to a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: str) -> list[bytes]:
    """The words of a text, lower-case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def exact(joined: bytes) -> list[tuple[int, str]]:
    """Places of the base phrases in words joined by spaces: (word number, label)."""
    hits = []
    held = b" " + joined + b" "
    for phrase, label in BASE:
        needle = f" {phrase} ".encode()
        at = held.find(needle)
        while at >= 0:
            hits.append((at, label))
            at = held.find(needle, at + 1)
    if not hits:
        return []
    spaces = np.flatnonzero(np.frombuffer(held, np.uint8) == 32)
    return list(zip(np.searchsorted(spaces, [at for at, _ in hits]).tolist(), (label for _, label in hits)))


def _bounds(text: str, low: int, high: int) -> tuple[list[int], list[int]]:
    """Where words start and end in text[low:high]."""
    starts, ends = [low] if low == 0 or text[low - 1] == " " else [], []
    at = text.find(" ", low, high)
    while at >= 0:
        ends.append(at)
        starts.append(at + 1)
        at = text.find(" ", at + 1, high)
    if high == len(text) or text[high] == " ":
        ends.append(high)
    return starts, ends


def fuzzy(text: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[int, int, str, int]]:
    """Best matches of notices in a normalised text: (start, end, label, edits), no two of one notice overlapping."""
    automaton, patterns = _compiled(notices)
    windows: dict[int, list[list[int]]] = {}
    for end, (size, uses) in automaton.iter(text):
        for k, at in uses:
            slack = allowed(notices[k][0])
            low = max(0, end - size + 1 - at - slack)
            high = min(len(text), low + len(notices[k][0]) + 2 * slack + 1)
            held = windows.setdefault(k, [])
            if held and low <= held[-1][1]:
                held[-1][1] = max(held[-1][1], high)
            else:
                held.append([low, high])
    out = []
    for k, spans in windows.items():
        notice, label = notices[k]
        slack, near = allowed(notice), []
        for low, high in spans:
            starts, ends = _bounds(text, low, high)
            for a in starts:
                for b in ends[bisect.bisect_left(ends, a + len(notice) - slack) : bisect.bisect_right(ends, a + len(notice) + slack)]:
                    if (m := patterns[k].fullmatch(text, a, b)) is not None:
                        near.append((sum(m.fuzzy_counts), a, b))
        taken: list[tuple[int, int]] = []
        for edits, a, b in sorted(near):
            at = bisect.bisect_left(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
                out.append((a, b, label, edits))
    return sorted(out)


def _places(text: str) -> list[tuple[int, int]]:
    """Start and end of each word in the text, in code points."""
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    spans: label, start and end in code points of the text, edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for value in batch.column(1):
                text = value.as_py() or ""
                words = normal(text)
                joined = b" ".join(words)
                base = exact(joined)
                flat = joined.decode("utf-8", "surrogatepass")
                near = fuzzy(flat, notices)
                spans, score = [], 1.0 if base else 0.0
                if near:
                    places, spaces = _places(text), [m.start() for m in re.finditer(" ", flat)]
                    for a, b, label, edits in near:
                        first, last = bisect.bisect_left(spaces, a), bisect.bisect_left(spaces, b)
                        spans.append({"label": label, "start": places[first][0], "end": places[last][1], "edits": edits})
                        score = max(score, 1 - edits / (b - a))
                labels = sorted({x for _, x in base})
                rows["n_words"].append(len(words))
                rows["n_base"].append(len(base))
                rows["first_word"].append(min((k for k, _ in base), default=None))
                rows["last_word"].append(max((k for k, _ in base), default=None))
                rows["base_labels"].append(",".join(labels))
                rows["labels"].append(",".join(sorted({*labels, *(x[2] for x in near)})))
                rows["score"].append(max(0.0, score))
                rows["spans"].append(spans)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows.values(), types))], names=["doc_id", *rows])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:long>>")
