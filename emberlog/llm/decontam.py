"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII characters, with A-Z as a-z.  A test item's
seeds are its GRAM-word runs that are rare in the corpus: those in at most RARE of all
documents, and of any two that follow each other the rarer one (both if they are equal), so that an item that was
copied a million times keeps seeds in every stretch: GRAM + 1 words of it that stand unchanged in a document always hold one.  Where a document holds a seed, the passage around it is aligned with
the item word by word (match 2, mismatch -1, gap -1); the score is the best local
alignment over that of a whole copy, 1 for an exact one.  A passage is as wide as the gaps
go that the threshold leaves room for, so it holds every alignment through the seed that reaches it.

Test items come to the driver in blocks of BLOCK_ITEMS (with MAX_WORDS words at most in a
block), and each block passes over the corpus once more: what is broadcast never grows
with either table.  Document counts of n-grams cover all documents.

Cases: a null or empty text or item matches nothing; an item of fewer than GRAM words is one
shorter seed, whatever its count (a one-word item is held by all documents with that word); an item in several rows of one item_id counts by its best row; repeated documents are rows of
their own; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.textnum import Texts, mix, slices, windows

GRAM = 3
RARE = 1e-4
THRESHOLD = 0.55
BLOCK_ITEMS = 20_000
MAX_WORDS = 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
BATCH = 256
#: Longer passages are aligned in pieces of so many starting words; a batch holds at most CELLS of padded words.
PIECE = 2048
CELLS = 1 << 18
#: Seed places are laid out in pieces of about so many.
HITS = 1 << 18

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and per text the number of its first word (n + 1 values)."""
    starts, ends = texts.spans(_INSIDE[texts.data])
    return texts.hashes(starts, ends, fold=True), np.searchsorted(starts, texts.offs)


@dataclass
class Items:
    """Items of a block as word hashes, and their seeds as sorted hashes with (item, place)."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    #: By number of words below GRAM: sorted hashes of whole items of so many words, and their items.
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Items:
        words, first = words_of(Texts(pa.array(texts, pa.large_string())))
        grams, at = windows(words, first, GRAM)
        item = np.searchsorted(first, at, side="right") - 1
        order = np.argsort(grams, kind="stable")
        short = {}
        for n in range(1, GRAM):
            own = np.flatnonzero(np.diff(first) == n)
            if len(own):
                runs, begins = windows(words, first, n)
                hashes = runs[np.searchsorted(begins, first[own])]
                rank = np.argsort(hashes, kind="stable")
                short[n] = hashes[rank], own[rank]
        return cls(np.array(ids, np.int64), words, first, grams[order], item[order], (at - first[item])[order], short)

    def keep(self, rare: np.ndarray) -> Items:
        return Items(self.ids, self.words, self.first, self.grams[rare], self.item[rare], self.place[rare], self.short)


def align(items: np.ndarray, sizes: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over rows: items (n, m) and passages (n, w) of word hashes, 0 where there is none.

    Returns the best score, and the first and last + 1 word of the passage that it covers.
    """
    n, m = items.shape
    w = passages.shape[1]
    h = np.zeros((n, w + 1), np.int32)
    begin = np.tile(np.arange(w + 1, dtype=np.int32), (n, 1))
    best, stop, start = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    steps = np.arange(w + 1, dtype=np.int32)
    for i in range(m):
        same = (passages == items[:, i : i + 1]) & (passages != 0)
        row = np.zeros((n, w + 1), np.int32)
        origin = np.tile(steps, (n, 1))
        across = h[:, :-1] + np.where(same, MATCH, MISMATCH)
        down = h[:, 1:] + GAP
        row[:, 1:] = np.maximum(np.maximum(across, down), 0)
        origin[:, 1:] = np.where((across >= down) & (across > 0), begin[:, :-1], np.where(down > 0, begin[:, 1:], steps[1:]))
        # gaps along the passage: the best earlier cell less a gap for each step
        lifted = row - GAP * steps
        top = np.maximum.accumulate(lifted, axis=1)
        better = top > lifted
        place = np.maximum.accumulate(np.where(better, 0, steps), axis=1)
        row = np.where(better, top + GAP * steps, row)
        origin = np.where(better, np.take_along_axis(origin, place, axis=1), origin)
        live = i < sizes
        row[~live] = 0
        h, begin = row, origin
        at = row.argmax(axis=1)
        high = np.take_along_axis(row, at[:, None], axis=1)[:, 0]
        more = high > best
        best[more], stop[more] = high[more], at[more]
        start[more] = np.take_along_axis(origin, at[:, None], axis=1)[:, 0][more]
    return best, start, stop


def gaps(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The most words that an alignment scoring threshold can insert or leave out, by item size."""
    return np.ceil(MATCH * sizes * (1 - min(threshold, 1.0)) / -GAP).astype(np.int64)


def _found(held: np.ndarray, item: np.ndarray, place: np.ndarray, grams: np.ndarray, at: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """(document, item, diagonal) rows of the places at where a text's grams are among the sorted held ones, each once in a piece of
    about HITS: a seed that many items share times its many places is never laid out at once."""
    if not len(held) or not len(grams):
        return
    low = np.searchsorted(held, grams, side="left")
    hit = np.flatnonzero((low < len(held)) & (held[np.minimum(low, len(held) - 1)] == grams))
    low = low[hit]
    counts = np.searchsorted(held, grams[hit], side="right") - low
    total = np.cumsum(counts)
    k = 0
    while k < len(hit):
        to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + HITS, side="right")))
        n = counts[k:to]
        which = np.repeat(low[k:to] - np.cumsum(n) + n, n) + np.arange(n.sum())
        spot = np.repeat(at[hit[k:to]], n)
        doc = np.searchsorted(first, spot, side="right") - 1
        yield np.unique(np.stack([doc, item[which], spot - first[doc] - place[which]], axis=1), axis=0)
        k = to


def _chained(rows: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """(document, item, first and last diagonal) of rows (document, item, first, last diagonal): those whose passages overlap are one row."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    # the furthest diagonal so far of the same pair: pairs lie far apart on one line
    group = np.concatenate([[0], np.cumsum(~same)])
    span = int(np.abs(rows[:, 2:]).max()) * 2 + 2 if len(rows) else 1
    far = np.maximum.accumulate(rows[:, 3] + group * span) - group * span
    new[1:] = ~same | (rows[1:, 2] > far[:-1] + reach[rows[1:, 1]])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(rows) - 1)
    return np.concatenate([rows[new][:, :3], far[ends][:, None]], axis=1)


def _hits(block: Items, words: np.ndarray, first: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """(document, item, diagonal, last diagonal) of the places where a document holds a seed, sorted;
    diagonals whose passages (reach words, by item) overlap are one row."""
    looked = [(block.grams, block.item, block.place, GRAM)] + [(h, own, np.zeros(len(own), np.int64), n) for n, (h, own) in block.short.items()]
    out = np.zeros((0, 4), np.int64)
    for held, item, place, n in looked:
        grams, at = windows(words, first, n)
        for rows in _found(held, item, place, grams, at, first):
            out = _chained(np.concatenate([out, rows[:, [0, 1, 2, 2]]]), reach)
    return out


def _passages(block: Items, words: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Document, item, and first and last + 1 word of each passage that may score threshold."""
    sizes = np.diff(block.first)
    slack = gaps(sizes, threshold)
    hits = _hits(block, words, first, sizes + 2 * slack)
    doc, item = hits[:, 0], hits[:, 1]
    low = np.maximum(hits[:, 2] - slack[item], 0)
    high = np.minimum(hits[:, 3] + sizes[item] + slack[item], np.diff(first)[doc])
    # no alignment covers more than its item's words and the gaps: pieces that overlap by as much lose none
    step = np.maximum(PIECE, sizes + slack)[item]
    n = np.maximum(1, -(-(high - low - sizes[item] - slack[item]) // step))
    row = np.repeat(np.arange(len(hits)), n)
    low = low[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step[row]
    doc, item, step = doc[row], item[row], step[row]
    high = np.minimum(high[row], low + step + sizes[item] + slack[item])

    def laid(start: np.ndarray, count: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(count)), count)
        return of, held[np.arange(len(of)) + np.repeat(start - np.cumsum(count) + count, count)]

    # only item words that stand in the passage can match
    may = np.zeros(len(doc), bool)
    for at in range(0, len(doc), BATCH):
        part = slice(at, at + BATCH)
        of, a = laid(block.first[item[part]], sizes[item[part]], block.words)
        by, b = laid(first[doc[part]] + low[part], (high - low)[part], words)
        salt = mix(np.arange(1, len(may[part]) + 1, dtype=np.uint64))
        there = np.sort(b ^ salt[by])
        key = a ^ salt[of]
        found = np.searchsorted(there, key)
        same = (found < len(there)) & (there[np.minimum(found, max(len(there) - 1, 0))] == key) if len(there) else np.zeros(len(key), bool)
        may[part] = np.bincount(of[same], minlength=len(may[part])) >= threshold * sizes[item[part]] - 1e-9
    return doc[may], item[may], low[may], high[may]


def _scores(block: Items, words: np.ndarray, first: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, last word + 1) of the best passage of each pair that may score threshold."""
    doc, item, low, high = _passages(block, words, first, threshold)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    sizes, width = np.diff(block.first)[item], high - low
    order = np.lexsort((width, sizes))
    k = 0
    while k < len(order):
        wide = np.maximum.accumulate(width[order[k : k + BATCH]])
        pick = order[k : k + max(1, int(np.searchsorted(wide * np.arange(1, len(wide) + 1), CELLS, side="right")))]
        k += len(pick)
        m, w, n = int(sizes[pick].max()), int(width[pick].max()), sizes[pick]
        cols, places = np.arange(m), np.arange(w)
        a = np.where(cols < n[:, None], block.words[np.minimum(block.first[item[pick]][:, None] + cols, len(block.words) - 1)], 0)
        b = np.where(places < width[pick][:, None], words[np.minimum((first[doc[pick]] + low[pick])[:, None] + places, len(words) - 1)], 0)
        got, start, stop = align(a, n, b)
        for j, row in enumerate(pick.tolist()):
            key = (int(doc[row]), int(item[row]))
            found = (float(got[j]) / (MATCH * int(n[j])), int(low[row] + start[j]), int(low[row] + stop[j]))
            if found > best.get(key, (0.0, 0, 0)):
                best[key] = found
    return [(*key, *value) for key, value in best.items()]


def _blocks(items: DataFrame) -> Iterator[Items]:
    """Items in blocks of bounded size, in the order of item_id."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for row in items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1]) // 2 + 1
        if len(ids) >= BLOCK_ITEMS or size >= MAX_WORDS:
            yield Items.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts)


def document_counts(docs: DataFrame, block: Items) -> tuple[np.ndarray, int]:
    """In how many documents each of the block's n-grams stands, and the number of documents."""
    spark = docs.sparkSession
    grams = np.unique(block.grams)
    sent = spark.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        sums, n = np.zeros(len(held), np.int64), 0
        for batch in slices(batches):
            words, first = words_of(Texts(batch.column(0)))
            found, at = windows(words, first, GRAM)
            k = np.searchsorted(held, found)
            hit = np.flatnonzero((k < len(held)) & (held[np.minimum(k, max(len(held) - 1, 0))] == found)) if len(held) else np.zeros(0, np.int64)
            pairs = np.unique((np.searchsorted(first, at[hit], side="right") - 1) * len(held) + k[hit])
            sums += np.bincount(pairs % len(held), minlength=len(held)) if len(held) else 0
            n += batch.num_rows
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(sums[some], n))], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts, total = np.zeros(len(grams), np.int64), 0
    for gram, n in zip(rows["gram"].to_pylist(), rows["n"].to_pylist()):
        if gram < 0:
            total = n
        else:
            counts[gram] = n
    return counts[np.searchsorted(grams, block.grams)], total


def rare_seeds(block: Items, counts: np.ndarray, total: int, rare: float = RARE) -> Items:
    """The seeds of a block: n-grams in few documents, and of any two that follow each other the rarer one."""
    order = np.lexsort((block.place, block.item))
    item, n = block.item[order], counts[order]
    keep = n <= max(1, rare * total)
    if len(order):
        joined = item[1:] == item[:-1]
        keep[:-1] |= joined & (n[:-1] <= n[1:])
        keep[1:] |= joined & (n[1:] <= n[:-1])
        lone = np.bincount(item, minlength=len(block.ids))[item] == 1
        keep |= lone
    out = np.zeros(len(order), bool)
    out[order] = keep
    return block.keep(out)


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word (exclusive): documents that hold a test item."""
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items):
        counts, total = document_counts(docs, block)
        sent = docs.sparkSession.sparkContext.broadcast(rare_seeds(block, counts, total))
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(_matcher(sent, threshold), schema))
    ranked = F.max_by(F.struct("first_word", "last_word"), "score")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), ranked.alias("at")).select("doc_id", "item_id", "score", "at.first_word", "at.last_word")


def _matcher(sent, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in slices(batches):
            words, first = words_of(Texts(batch.column(1)))
            rows = [r for r in _scores(block, words, first, threshold) if r[2] >= threshold]
            docs = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array([int(block.ids[r[1]]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold a test item.  Documents without a doc_id stay."""
    bad = matches(docs, items, threshold).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
