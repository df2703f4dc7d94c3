"""Quality rules as a short-circuit cascade.

Each rule has a cost and a selectivity, both estimated on a sample of about SAMPLE_ROWS texts: the
cost is the number of array elements that its measures touch (EFFORT for each byte), so it is the same in every run, and
a measure that an earlier rule has taken is free.  Rules are put in order one after the other: next comes the
rule with the most rejections per cost among the sampled texts that are still in play.  A rule only sees the
documents that all rules before it kept.  The order changes the time and never which documents are
kept, because a document is kept if no rule rejects it.

The sample is a share of all rows by a hash of doc_id and text; it is judged where it lies, and only
one count for each set of rejecting rules comes to the driver.

Cases: a null or empty text has no words and is rejected; repeated rows are judged alike; a null doc_id changes nothing; an empty
table gives an empty table; other columns pass through ``cascade`` untouched whatever they are called, but for
one called rejected_by, which ``cascade(keep=False)`` replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.textnum import Texts, WORD, owner, slices, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SAMPLE_ROWS = 2000
#: Array elements that a measure touches for each byte of text.
EFFORT = {"n_words": 4, "word_chars": 3, "n_symbols": 2, "n_dup_lines": 8, "n_repeat_words": 24}


class Measures:
    """Measures of some texts, each computed once and only when asked for."""

    def __init__(self, column: pa.Array):
        self.column, self._texts, self._had = column, None, {}

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._had:
            self._had[name] = getattr(self, "_" + name)()
        return self._had[name]

    @property
    def texts(self) -> Texts:
        if self._texts is None:
            self._texts = Texts(self.column)
        return self._texts

    def only(self, rows: np.ndarray) -> Measures:
        """The measures of some of the texts; those already taken are taken along."""
        out = Measures(self.column.take(pa.array(rows)))
        out._had = {name: held[rows] for name, held in self._had.items()}
        return out

    def _n_words(self) -> np.ndarray:
        return np.diff(self.texts.words()[2])

    def _word_chars(self) -> np.ndarray:
        data = self.texts.data
        return self.texts.per_text(WORD[data] & ((data & 0xC0) != 0x80))

    def _n_symbols(self) -> np.ndarray:
        return self.texts.per_text(SYMBOLS[self.texts.data])

    def _n_dup_lines(self) -> np.ndarray:
        t = self.texts
        feeds = np.flatnonzero(t.data == 10)
        starts = np.sort(np.concatenate([t.offs[:-1], feeds + 1]))
        of = np.sort(np.concatenate([np.arange(len(t)), np.searchsorted(t.offs[1:], feeds, side="right")]))
        ends = np.minimum(np.concatenate([starts[1:] - 1, t.offs[-1:]]), t.offs[1:][of])
        ends[np.flatnonzero(of[1:] != of[:-1])] = t.offs[1:][of[:-1][of[1:] != of[:-1]]]
        ends = np.maximum(ends, starts)
        words = np.zeros(len(t.data) + 1, np.int64)
        np.cumsum(WORD[t.data], out=words[1:])
        worded = words[ends] > words[starts]
        starts, ends, of = starts[worded], ends[worded], of[worded]
        return np.bincount(of[_repeats(t.hashes(starts, ends), of)], minlength=len(t))

    def _n_repeat_words(self) -> np.ndarray:
        starts, ends, first = self.texts.words()
        hashes, at = windows(self.texts.hashes(starts, ends), first, 5)
        doc = owner(first, len(starts))
        key = _keyed(hashes, doc[at])
        order = np.argsort(key)
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        many = np.zeros(len(key), bool)
        many[1:] |= same
        many[:-1] |= same
        hit = at[order[many]]
        cover = np.zeros(len(starts) + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(self.texts))


def _keyed(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _repeats(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether an equal item of the same text stands before each item."""
    key = _keyed(hashes, of)
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


@dataclass(frozen=True)
class Rule:
    """reject gets the Measures of the texts still in play, and says which to drop."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[Measures], np.ndarray]


#: The default rules.  The first two are the fixed base; the others only take
#: texts that are plainly not prose: symbol floods and texts of mostly repeated lines.
RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 10),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbol_flood", ("n_symbols", "n_words"), lambda m: 4 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", ("n_dup_lines", "n_words"), lambda m: 20 * m["n_dup_lines"] > m["n_words"]),
    Rule("odd_word_length", ("word_chars", "n_words"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 30 * m["n_words"])),
)


def verdicts(measures: Measures, rules: tuple[Rule, ...]) -> np.ndarray:
    """Per text the number of the rule that rejected it, or -1; later rules see only survivors."""
    out = np.full(len(measures), -1, np.int32)
    alive = np.arange(len(measures))
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        bad = rule.reject(measures)
        if bad.any():
            out[alive[bad]] = k
            alive, measures = alive[~bad], measures.only(np.flatnonzero(~bad))
    return out


def _sampled(docs: DataFrame, rules: tuple[Rule, ...], text: str, sample_rows: int) -> list[tuple[int, int, int]]:
    """(set of rejecting rules as bits, texts, their bytes) of a sample of docs."""
    total = docs.count()
    if not total:
        return []
    ids = [F.col(c) for c in docs.columns if c == "doc_id"]
    share = min(1.0, sample_rows / total)
    picked = docs.filter(F.pmod(F.xxhash64(*ids, F.col(text)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = Measures(batch.column(0))
            bits = np.zeros(len(m), np.int64)
            for k, rule in enumerate(rules):
                bits |= rule.reject(m).astype(np.int64) << k
            yield pa.RecordBatch.from_arrays([pa.array(bits), pa.array(np.diff(m.texts.offs))], names=["bits", "size"])

    rows = picked.mapInArrow(run, "bits long, size long").groupBy("bits").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    return sorted((r["bits"], r["n"], r["size"]) for r in rows)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejections per cost, each among the sampled texts that the rules before it leave."""
    left, rest = _sampled(docs, rules, text, sample_rows), list(range(len(rules)))
    taken: set[str] = set()
    ordered: list[Rule] = []
    while rest:
        size = sum(b for _, _, b in left)

        def worth(k: int) -> tuple[float, int]:
            cost = 1 + size * (1 + sum(EFFORT[name] for name in rules[k].needs if name not in taken))
            return -sum(n for bits, n, _ in left if bits >> k & 1) / cost, k

        best = min(rest, key=worth)
        rest.remove(best)
        taken.update(rules[best].needs)
        left = [x for x in left if not x[0] >> best & 1]
        ordered.append(rules[best])
    return tuple(ordered)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, keep: bool = True) -> DataFrame:
    """The documents that no rule rejects (keep), or all with a column rejected_by: the first rule that does."""
    ordered = order_rules(docs, rules, text, sample_rows)
    names = [r.name for r in ordered]
    if not keep:
        docs = docs.drop("rejected_by")
    schema = docs.schema if keep else T.StructType([*docs.schema.fields, T.StructField("rejected_by", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            said = verdicts(Measures(batch.column(text)), ordered)
            if keep:
                yield batch.filter(pa.array(said < 0))
            else:
                why = pa.array([names[k] if k >= 0 else None for k in said], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, why], names=[*batch.schema.names, "rejected_by"])

    return docs.mapInArrow(run, schema)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document the base measures, base_failed, and the cascade's verdict: kept and rejected_by.

    The base measures are wanted of every text; the cascade takes them from there and decides
    on survivors only.
    """
    ordered = order_rules(docs, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = Measures(batch.column(1))
            base = [pa.array(m[n], pa.int64()) for n in names]
            failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
            said = verdicts(m, ordered)
            why = pa.array([ordered[k].name if k >= 0 else None for k in said], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *base, pa.array(failed), pa.array(~failed & (said < 0)), why], names=["doc_id", *names, "base_failed", "kept", "rejected_by"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, rejected_by string")
