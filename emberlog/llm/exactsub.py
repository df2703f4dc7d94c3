"""Exact substring deduplication by distributed prefix doubling.

A byte goes if a WIDTH-byte string that covers it also starts in a document with a
smaller doc_id.  Positions are ranked by their prefixes at growing lengths, sorted by
Spark and ranked anew, as a suffix array is built by prefix doubling, with two differences
that keep it small: a position is dropped as soon as its prefix is unique, and the first rank is
taken only at positions that the text itself chooses.

1. Rank at GRAM = WIDTH / 2 bytes.  Every WIDTH-byte string has one anchor, the place of the smallest fingerprint
   of a GRAM-byte string inside it, so equal strings have equal anchors.  Anchors are sorted by
   rank; those whose GRAM bytes stand in one document only are unique and go no further.
2. Rank at the reach of an anchor.  The strings that have an anchor start one after the other, and
   all are equal to another anchor's if the bytes from the first one's start to the last
   one's end are.  Equal reaches share a rank, and the smallest document of a rank covers the
   reach of all others: copies, however many, end here.
3. Rank at WIDTH bytes, by the pairs of ranks WIDTH / 2 apart: for the strings of one reach of each
   rank (in its smallest document), where its anchor stands in other reaches too.

A rank is named by the 64-bit fingerprint of its prefix; two prefixes share it if and only if they
are equal, but for a chance of 2 ** -64 a pair.

Cases: a null or empty text has no byte; texts shorter than WIDTH lose none; rows that share a doc_id
are told apart by their text and never count against each other (equal rows are judged alike); a
null doc_id counts as the largest; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.scratch import materialize, remove
from emberlog.llm.textnum import _BYTE, Texts, _powers, mix, slices

WIDTH = 50
HALF = WIDTH // 2
GRAM = HALF
REACH_BITS = 8
SLICE = 1 << 20
PARTS = 2
HELD = 100_000
LAST = (1 << 63) - 1  # the doc_id that stands for null


class Prints:
    """Fingerprints of any byte spans of some texts."""

    def __init__(self, texts: Texts):
        power, self.back = _powers(len(texts.data) + 1)
        self.sums = np.zeros(len(texts.data) + 1, np.uint64)
        np.cumsum(_BYTE[texts.data] * power[: len(texts.data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def anchors(texts: Texts, prints: Prints) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, first start, last start, rank at GRAM) of each anchor: the WIDTH-byte strings that start
    from first to last start have it.  Positions are within the batch."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    n = len(texts.data)
    if n < WIDTH:
        return none
    at = np.arange(n - GRAM + 1)
    grams = (prints.sums[GRAM:] - prints.sums[:-GRAM]) * prints.back[: len(at)]
    # the leftmost smallest of each run of grams, by doubling the length that is known; places fill the low half, so
    # grams that share the high half tie, and ties fall alike in equal strings
    best = grams & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64)
    span, known = WIDTH - GRAM + 1, 1
    while known < span:
        step = min(known, span - known)
        best = np.minimum(best[step:], best[:-step])
        known += step
    place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # starts of strings that stay in their text
    sizes = np.maximum(np.diff(texts.offs) - WIDTH + 1, 0)
    total = int(sizes.sum())
    if not total:
        return none
    begins = np.cumsum(sizes) - sizes
    starts = np.repeat(texts.offs[:-1] - begins, sizes) + np.arange(total)
    of = np.repeat(np.arange(len(texts)), sizes)
    chosen = place[starts]
    new = np.ones(total, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, total - 1)
    return of[first], chosen[first], starts[first], starts[last], mix(grams[chosen[first]])


def _settled(whole: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the same reach stands in a smaller document of the same batch, which settles it before any shuffle."""
    order = np.lexsort((doc, whole))
    new = np.ones(len(order), bool)
    new[1:] = whole[order[1:]] != whole[order[:-1]]
    begins = np.flatnonzero(new)
    out = np.zeros(len(order), bool)
    if len(order):
        out[order] = doc[order] > doc[order[begins]][np.cumsum(new) - 1]
    return out


def _anchor_rows(docs: DataFrame, part: int, parts: int) -> DataFrame:
    """doc, tag, span (start and reach: bytes of all strings of the anchor), gram, whole (fingerprints of anchor and
    reach), of the anchors whose gram falls in one of so many parts.  Settled ones have a null whole and a gram
    of their own, so that the copies of one text are dealt over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            texts = Texts(batch.column(2))
            prints = Prints(texts)
            of, at, first, last, gram = anchors(texts, prints)
            own = gram % np.uint64(parts) == part
            of, at, first, last, gram = of[own], at[own], first[own], last[own], gram[own]
            whole = prints.of(first, last + WIDTH) + mix((at - first).astype(np.uint64) + np.uint64(1))
            span = (first - texts.offs[of]) << REACH_BITS | (last - first + WIDTH)
            where = pa.array(of)
            doc = batch.column(0).take(where)
            settled = _settled(whole, doc.to_numpy())
            gram = np.where(settled, mix(whole + mix(span.astype(np.uint64) + at.astype(np.uint64))), gram)
            yield pa.RecordBatch.from_arrays([doc, batch.column(1).take(where), pa.array(span), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64), mask=settled)], names=["doc", "tag", "span", "gram", "whole"])

    return docs.mapInArrow(run, "doc long, tag long, span long, gram long, whole long")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tag, span, whole, first of anchors that come sorted by gram, whole, doc.

    Those whose reach stands in a smaller document come with a null whole, as settled ones came.  Of the others (in the first document of
    their reach) those come whose gram has several reaches; first marks one for each reach.  Only what the next batch
    needs is held: the last gram and reach, and rows whose gram has shown one reach so far (let through beyond HELD, as that
    costs time but changes no result)."""

    def rows(cols: list[np.ndarray], own: bool) -> pa.RecordBatch:
        doc, tag, span, whole, first = cols
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(span), pa.array(whole) if own else pa.nulls(len(doc), pa.int64()), pa.array(first)], names=["doc", "tag", "span", "whole", "first"])

    last_gram = last_whole = head = None
    only = False  # whether the last reach is the first one of its gram
    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        settled = batch.column(4).is_null()
        if settled.true_count:
            doc, tag, span = (batch.column(k).filter(settled).to_numpy() for k in range(3))
            yield rows([doc, tag, span, None, np.zeros(len(doc), bool)], False)
            batch = batch.filter(batch.column(4).is_valid())
        if not batch.num_rows:
            continue
        doc, tag, span, gram, whole = (c.to_numpy() for c in batch.columns)
        new_gram, new_reach = np.ones(len(doc), bool), np.ones(len(doc), bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new_gram[0] = last_gram is None or gram[0] != last_gram
        new_reach[1:] = new_gram[1:] | (whole[1:] != whole[:-1])
        new_reach[0] = new_gram[0] or whole[0] != last_whole
        g, r, begins = np.cumsum(new_gram), np.cumsum(new_reach), np.flatnonzero(new_reach)
        heads = np.concatenate([[doc[0] if head is None else head], doc[begins]])
        lone = np.concatenate([[only], new_gram[begins]])[r]
        more = np.zeros(g[-1] + 1, bool)
        more[g[new_reach & ~new_gram]] = True
        later = doc > heads[r]
        yield rows([c[later] for c in (doc, tag, span, whole, new_reach)], False)
        if waiting and more[0]:
            yield from (rows(w, True) for w in waiting)
        if more[0] or g[-1] > 0:
            waiting = []
        ready = ~later & (~lone | more[g])
        yield rows([c[ready] for c in (doc, tag, span, whole, new_reach)], True)
        wait = ~later & lone & ~more[g] & (g == g[-1])
        if wait.any():
            waiting.append([c[wait] for c in (doc, tag, span, whole, new_reach)])
            if sum(len(w[0]) for w in waiting) > HELD:
                yield from (rows(w, True) for w in waiting)
                waiting = []
        last_gram, last_whole, head, only = gram[-1], whole[-1], heads[r[-1]], bool(lone[-1])


def _reach_bytes(docs: DataFrame) -> DataFrame:
    """whole, doc, text: the bytes of the wanted reaches of docs (doc, text, wanted: array of struct(span, whole))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            texts = Texts(batch.column(1))
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            span, whole = (lists.values.field(k).to_numpy()[bounds[0] : bounds[-1]] for k in (0, 1))
            of = np.repeat(np.arange(len(texts)), np.diff(bounds))
            sizes = span & ((1 << REACH_BITS) - 1)
            offs = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes, out=offs[1:])
            data = texts.data[np.repeat((span >> REACH_BITS) + texts.offs[of] - offs[:-1], sizes) + np.arange(offs[-1])]
            text = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(whole), batch.column(0).take(pa.array(of)), text], names=["whole", "doc", "text"])

    return docs.mapInArrow(run, "whole long, doc long, text binary")


def _string_rows(reaches: DataFrame, part: int, parts: int) -> DataFrame:
    """whole, doc, place, rank: the WIDTH-byte strings of the reaches (whole, doc, text) whose rank, a pair of their
    halves' ranks, falls in one of so many parts; place counts from the start of the reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            texts = Texts(batch.column(2))
            prints = Prints(texts)
            sizes = np.diff(texts.offs) - WIDTH + 1
            of = np.repeat(np.arange(len(texts)), sizes)
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = texts.offs[of] + place
            rank = mix(prints.of(at, at + HALF) * np.uint64(3) + prints.of(at + HALF, at + WIDTH))
            own = np.flatnonzero(rank % np.uint64(parts) == part)
            where = pa.array(of[own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(place[own].astype(np.int32)), pa.array(rank[own].view(np.int64))], names=["whole", "doc", "place", "rank"])

    return reaches.mapInArrow(run, "whole long, doc long, place int, rank long")


def _fewer(df: DataFrame, together: int) -> DataFrame:
    """df in fewer tasks, where that leaves one for each core: each takes so many shuffled partitions, one after the other, so that
    it holds no more at a time.  That makes fewer and larger scratch files; on a local path Hadoop starts processes for each file, and one
    that does not run its own program yet reports the JVM's memory as its own."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // together)))


def covered(docs: DataFrame) -> DataFrame:
    """doc, tag, span (start and size): pieces of the texts (doc, tag, text) that stand in a smaller doc as well."""
    spark, scratch = docs.sparkSession, []

    def keep(df: DataFrame, label: str) -> DataFrame:
        held = materialize(df, label, release=True)
        scratch.append(held)
        return held

    # Ranks at GRAM bytes and of the whole reach in one sort of all anchors by both, one part of the grams after the
    # other, so that only a part is on disk at a time
    held = []
    for part in range(PARTS):
        ranked = _anchor_rows(docs, part, PARTS).repartition("gram").sortWithinPartitions("gram", "whole", "doc")
        held.append(keep(_fewer(ranked.mapInArrow(_ranked, "doc long, tag long, span long, whole long, first boolean"), 2), "live"))
        del ranked
    live = functools.reduce(DataFrame.unionByName, held)
    # anchors that stand in several reaches: rank the strings one by one, in the first document of each reach
    wanted = live.filter("first").groupBy("doc", "tag").agg(F.collect_set(F.struct("span", "whole")).alias("wanted"))
    reaches = keep(_fewer(_reach_bytes(docs.join(wanted, ["doc", "tag"]).select("doc", "text", "wanted")), 2), "reaches")
    rank = Window.partitionBy("rank")
    strings = functools.reduce(DataFrame.unionByName, [keep(_fewer(_string_rows(reaches, part, PARTS).withColumn("low", F.min("doc").over(rank)).filter("doc > low").select("whole", "doc", "place"), 4), "strings") for part in range(PARTS)])
    gone = strings.groupBy("whole", "doc").agg(F.collect_set("place").alias("places"))
    # wherever that document has this reach
    start = F.shiftright("span", REACH_BITS)
    places = live.filter("whole IS NOT NULL").join(gone, ["whole", "doc"]).select("doc", "tag", start.alias("start"), F.explode("places").alias("place"))
    places = places.select("doc", "tag", F.shiftleft(F.col("start") + F.col("place"), REACH_BITS).bitwiseOR(F.lit(WIDTH)).alias("span"))
    pieces = materialize(live.filter("whole IS NULL").select("doc", "tag", "span").unionByName(_fewer(places, 4)), "pieces", release=True)
    for df in scratch:  # the pieces are written and need none of these
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(spark, path)
    return pieces


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept of rows doc_id, text, pieces."""
    for batch in slices(batches, size=SLICE):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, pieces in zip(batch.column(1), batch.column(2)):
            raw = text.as_buffer() if text.is_valid else b""
            kept, removed, spans = raw, 0, 0
            if pieces.is_valid and len(pieces.values):
                span = pieces.values.to_numpy()
                start, size = span >> REACH_BITS, span & ((1 << REACH_BITS) - 1)
                marks = np.zeros(len(raw) + 1, np.int32)
                np.add.at(marks, start, 1)
                np.add.at(marks, start + size, -1)
                gone = np.cumsum(marks[:-1]) > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            for k, v in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), bytes(kept))):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())], names=["doc_id", *out])


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (bytes)."""
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("tag"))
    pieces = covered(keyed.select("doc", "tag", "text")).groupBy("doc", "tag").agg(F.collect_set("span").alias("pieces"))
    return keyed.join(pieces, ["doc", "tag"], "left").select("doc_id", "text", "pieces").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
