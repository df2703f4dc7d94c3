"""Near-duplicate documents: HyperMinHash sketches, banding, exact confirmation, components.

A document's set holds its distinct 5-word shingles.  A sketch has BANDS rounds of ROWS
buckets; a bucket keeps the smallest hash that fell into it as the count of its leading
zeros and the MANTISSA bits that follow, packed in 16 bits (0: empty bucket).  The ROWS
registers of a round, side by side, are the 64-bit key of its band.  Two sets of
similarity s agree in a round with a chance of about s ** ROWS, so of 28 rounds of 4 at
least one agrees with a chance of 0.99998 at s = 0.75.

Documents with equal sets form one class, known by a 64-bit digest of the set, and only classes
go on.  In a bucket (one band, one key) every class is held against the smallest one;
the Jaccard estimate from the registers, less the collisions that random registers
would give, drops pairs that are plainly too far apart; the rest is confirmed on the
full sets.  Confirmed links give components.  Where a bucket still holds more than one
component, its classes outside the largest one are held against all others, block by block:
a task has two blocks of about BLOCK texts (fewer if they are long), estimates and confirms their pairs
in memory, and returns links between components alone.  So no link that a shared band
shows is lost, and no group is ever spread out into rows of pairs.

Hot keys: a bucket, a set or a component may hold a third of all rows.  What is known of each of them is added up
first (map-side) and written; the join back is then one of two plain shuffles, many to one, which AQE splits where one key
fills a partition.

Cases: a null or empty text has an empty set and links with nothing; with fewer than five
words the whole sequence is the one shingle; rows are documents of their own, also where they share a doc_id
or repeat in all columns; a null doc_id is not compared.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.scratch import Scratch, materialize
from emberlog.llm.textnum import Texts, mix, owner, slices, windows

SHINGLE = 5
BANDS, ROWS, MANTISSA = 28, 4, 10
SIMILAR = 75  # in hundredths
#: Registers are independent draws: 112 of them put the estimate of 0.75 below 0.5 with a chance under 1e-8.
DOUBT = 0.5
#: How often a pair of registers of different sets is equal by chance: about 2 ** -MANTISSA / 2.
CHANCE = 2.0 ** -(MANTISSA + 1)

_STEPS = np.random.default_rng(77).integers(1, 1 << 62, BANDS, dtype=np.uint64) * np.uint64(4) + np.uint64(3)


def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and n + 1 bounds."""
    starts, ends, first = texts.words()
    words = texts.hashes(starts, ends, fold=True)
    hashes, at = windows(words, first, SHINGLE)
    counts = np.diff(first)
    doc = owner(first, len(starts))[at]
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        # a short sequence: its words' hashes summed by place, and their number
        short = np.zeros(len(few), np.uint64)
        for j in range(SHINGLE - 1):
            has = counts[few] > j
            short[has] = mix(short[has] + words[first[few[has]] + j] + np.uint64(j + 1))
        hashes, doc = np.concatenate([hashes, mix(short + counts[few].astype(np.uint64))]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out, sizes = np.empty_like(hashes), np.zeros(len(texts), np.int64)
    at = 0
    for k in np.flatnonzero(np.diff(bounds)):
        part = np.sort(hashes[bounds[k] : bounds[k + 1]])
        part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        out[at : at + len(part)] = part
        sizes[k] = len(part)
        at += len(part)
    return out[:at], np.concatenate([[0], np.cumsum(sizes)])


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, BANDS * ROWS) registers of non-empty sets; hashes of one set lie together."""
    begins = bounds[:-1]
    out = np.zeros((len(begins), BANDS, ROWS), np.uint16)
    top = np.uint64(64 - ROWS.bit_length() + 1)
    low = np.uint64((1 << int(top)) - 1)
    for band in range(BANDS):
        x = hashes * _STEPS[band]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        for row in range(ROWS):
            least = np.minimum.reduceat(x ^ (np.uint64(row) << top), begins)
            full = (least >> top) == 0
            out[:, band, row] = np.where(full, _register(least & low, int(top)), 0)
    return out.reshape(len(begins), -1)


def _register(value: np.ndarray, bits: int) -> np.ndarray:
    """Leading zeros of a bits-wide value, capped at 62, plus one, and the MANTISSA bits after its first one."""
    value = value | np.uint64(1)
    high = value.astype(np.float64)
    length = np.frexp(high)[1].astype(np.int64)
    length -= (value >> (length - 1).astype(np.uint64)) == 0  # a rounding up to the next power
    zeros = np.minimum(bits - length, 62)
    shift = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    rest = (value >> shift) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | rest).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch pairs (rows), corrected for registers equal by chance."""
    some = (a > 0) | (b > 0)
    n = np.maximum(some.sum(axis=1), 1)
    equal = ((a == b) & some).sum(axis=1)
    return np.maximum(0.0, (equal - CHANCE * n) / (n * (1 - CHANCE)))


def _digest(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit sum that stands for a whole set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    return mix(np.diff(sums[bounds])).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id and tag of docs, n_shingles, a digest of the set (rep), and its sketch (binary, null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, bounds = shingle_sets(Texts(batch.column(1)))
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            made: list[bytes | None] = [None] * len(sizes)
            if len(full):
                for k, row in zip(full.tolist(), sketches(hashes, np.append(bounds[full], bounds[-1]))):
                    made[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.array(_digest(hashes, bounds)), pa.array(made, pa.binary())], names=["doc_id", "tag", "n_shingles", "rep", "sketch"])

    return docs.select("doc_id", "text", "tag").mapInArrow(run, "doc_id long, tag long, n_shingles long, rep long, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    """Band and key of each class: rep, band, key.  The band's number is mixed into the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, BANDS, ROWS)
            keys = np.ascontiguousarray(raw).view(np.uint64)[:, :, 0]
            keys = mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            rep = np.repeat(batch.column(0).to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int8), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(band), pa.array(keys.reshape(-1))], names=["rep", "band", "key"])

    return classes.select("rep", "sketch").mapInArrow(run, "rep long, band byte, key long")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose estimate doesn't rule it out."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    near = joined.filter((100 * F.least("n_a", "n_b")) >= SIMILAR * F.greatest("n_a", "n_b")).select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(estimate(x, y) >= DOUBT))

    return near.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar.

    All texts that are held against one text a go to the tasks of a, cut by a salt into
    runs of about CHUNK; each task has one set of a and one batch in memory at a time.
    """
    pairs = scratch.keep(pairs, "pairs")
    sized = scratch.keep(pairs.groupBy("a").agg(F.count("*").alias("n")), "counts")
    salted = pairs.join(sized, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("salt"))
    text = texts.select(F.col("rep").alias("id"), "text")
    # the text of a comes once for every salt, before the texts of its partners
    heads = salted.select("a", "salt", F.col("a").alias("id"), F.lit(0).alias("part")).distinct()
    wanted = heads.unionByName(salted.select("a", "salt", F.col("b").alias("id"), F.lit(1).alias("part")))
    rows = wanted.join(text, "id").select("a", "salt", "part", "id", "text").repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for batch in slices(batches):
            keys, parts_, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            hashes, bounds = shingle_sets(Texts(batch.column(4)))
            a, b = [], []
            for k in range(len(keys)):
                part = hashes[bounds[k] : bounds[k + 1]]
                if parts_[k] == 0:
                    head, own = keys[k], part
                    continue
                if head == keys[k] and _similar(own, part):
                    a.append(keys[k])
                    b.append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _across(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components that share a bucket: members (key, band, rep)."""
    sized = scratch.keep(labels.join(classes.select("rep", "n_shingles"), "rep"), "sized")
    placed = scratch.keep(members.select("key", "band", "rep").join(sized, "rep"), "placed")
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    most = F.max(F.struct("c", "component", "s"))
    mixed = shares.groupBy("key").agg(F.sum("c").alias("n"), F.sum("s").alias("all"), most.alias("top")).select("key", "n", "all", F.col("top.component").alias("top"), F.col("top.c").alias("c"), F.col("top.s").alias("s")).filter("n > c")
    held = placed.join(scratch.keep(mixed, "mixed"), "key").withColumn("left", F.col("component") != F.col("top"))
    block = lambda size: F.pmod(F.xxhash64("rep"), size).cast("int")
    blocks = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES))
    lefts, rights = blocks(F.col("n") - F.col("c"), F.col("all") - F.col("s")), blocks(F.col("n"), F.col("all"))
    every = lambda size: F.explode(F.sequence(F.lit(0), (size - 1).cast("int")))
    own = ("key", "band", "rep", "component")
    sides = held.filter("left").select(*own, block(lefts).alias("l"), every(rights).alias("r"), F.lit(0).alias("side")).unionByName(held.select(*own, every(lefts).alias("l"), block(rights).alias("r"), F.lit(1).alias("side")))
    full = classes.select("rep", "sketch").join(texts, "rep")
    rows = sides.join(full, "rep").select("key", "l", "r", "side", "band", "rep", "component", "sketch", "text").repartition(parts, "key", "l", "r").sortWithinPartitions("key", "l", "r", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the block pair that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            ids = np.stack([held.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            cut = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            bounds = [0, *cut.tolist()]
            for lo, hi in zip(bounds, bounds[1:]):
                yield _links_within(held.slice(lo, hi - lo))
            held = held.slice(bounds[-1])
        if held is not None:
            yield _links_within(held)

    return rows.mapInArrow(run, "a long, b long")


def _links_within(rows: pa.Table) -> pa.RecordBatch:
    """The links that join components of one block pair; rows of side 0 against those of side 1."""
    side, rep, component = (rows.column(k).to_numpy() for k in (3, 5, 6))
    band = int(rows.column(4)[0].as_py())
    marks = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint16).reshape(len(rep), BANDS * ROWS)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    outside = set(rep[left].tolist())
    twice = np.array([x in outside for x in rep[right].tolist()], bool)
    a: list[int] = []
    b: list[int] = []
    near: list[tuple[int, np.ndarray]] = []
    for i in left.tolist():
        able = (component[right] != component[i]) & ~(twice & (rep[right] < rep[i]))
        able[able] = estimate(np.broadcast_to(marks[i], (int(able.sum()), BANDS * ROWS)), marks[right[able]]) >= DOUBT
        if able.any():
            # only in the first band that both share
            others = right[able]
            first = (marks[others].reshape(-1, BANDS, ROWS) == marks[i].reshape(BANDS, ROWS)).all(axis=2).argmax(axis=1)
            near.append((i, others[first == band]))
    wanted = np.unique(np.concatenate([np.concatenate([[i], js]) for i, js in near])) if near else np.zeros(0, np.int64)
    if len(wanted):
        hashes, bounds = shingle_sets(Texts(rows.column(8).take(pa.array(wanted))))
        place = {int(k): n for n, k in enumerate(wanted.tolist())}
        root = {int(c): int(c) for c in component.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, js in near:
            own = hashes[bounds[place[i]] : bounds[place[i] + 1]]
            for j in js.tolist():
                p, q = find(int(component[i])), find(int(component[j]))
                if p == q:
                    continue
                other = hashes[bounds[place[j]] : bounds[place[j] + 1]]
                if _similar(own, other):
                    root[max(p, q)] = min(p, q)
                    a.append(int(rep[i]))
                    b.append(int(rep[j]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _similar(own: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = (own, other) if len(own) <= len(other) else (other, own)
    if not len(small) or 100 * len(small) < SIMILAR * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= SIMILAR * (len(own) + len(other) - both)


CHUNK = 256
BLOCK = 256
BLOCK_SHINGLES = 1 << 18


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """rep, component: the smallest rep reachable over links (a, b); for all rows of nodes (rep).

    Labels sink along links and then along labels (a label's own label), so the
    number of rounds grows as the logarithm of the longest path.
    """
    both = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    linked = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("rep"), "label"), "labels")
    while True:
        near = both.join(linked.select(F.col("rep").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("least"))
        sunk = linked.join(near.withColumnRenamed("a", "rep"), "rep").select("rep", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        jump = sunk.select(F.col("rep").alias("at"), F.col("label").alias("next"))
        moved = scratch.keep(sunk.join(jump, sunk["label"] == jump["at"]).select("rep", "was", F.least("label", "next").alias("label")), "labels")
        linked = moved.select("rep", "label")
        if not moved.filter("label <> was").limit(1).count():
            break
    return nodes.select("rep").join(linked, "rep", "left").select("rep", F.coalesce("label", "rep").alias("component"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text, tag): the rows (doc_id, tag, n_shingles, rep), and for each set (rep) its component and
    the smallest doc_id of that."""
    scratch = Scratch(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = scratch.keep(sketch(docs), "sketch")
    full = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # one class for each set, with the doc_id and tag of one smallest document
    classes = scratch.keep(full.groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.min_by("tag", "doc_id").alias("tag"), F.min("n_shingles").alias("n_shingles"), F.min_by("sketch", "doc_id").alias("sketch")), "classes")
    buckets = scratch.keep(_bands(classes), "bands")
    heads = scratch.keep(buckets.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).filter("n > 1"), "heads")
    members = scratch.keep(buckets.join(heads, "key").select("key", "band", "rep", "head", "n"), "members")
    pairs = members.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    tested = _likely(pairs, classes)
    owners = classes.select("rep")
    # only classes that share a bucket are ever confirmed: their texts are gathered once
    sharing = classes.select("rep", "doc_id", "tag").join(members.select("rep").distinct(), "rep", "left_semi")
    texts = docs.select("doc_id", "tag", "text").join(sharing, ["doc_id", "tag"]).select("rep", "text")
    if full.groupBy("doc_id", "tag").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["rep"])
    texts = scratch.keep(texts, "texts")
    links = scratch.keep(_confirm(tested, texts, parts, scratch), "confirmed")
    labels = scratch.keep(components(owners, links, scratch), "components")
    more = scratch.keep(_across(members.filter("n > 2"), labels, classes, texts, parts, scratch), "confirmed")
    if more.limit(1).count():
        labels = scratch.keep(components(owners, links.unionByName(more), scratch), "components")
    least = scratch.keep(labels.join(classes.select("rep", "doc_id"), "rep").groupBy("component").agg(F.min("doc_id").alias("smallest")), "smallest")
    settled = scratch.keep(labels.join(least, "component").select("rep", "component", "smallest"), "settled")
    scratch.close(made, settled)
    return made.drop("sketch"), settled


def classify(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_shingles, component_id and kept (the smallest doc_id of its component)."""
    made, settled = _grouped(docs.select("doc_id", "text", F.xxhash64("text").alias("tag")))
    able = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    linked = made.filter(able).join(settled, "rep").select("doc_id", "n_shingles", F.col("smallest").alias("component_id"))
    alone = made.filter(~able).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each group of near copies, with the columns of docs.

    It is the one with the smallest doc_id; of several with that id the one with the smallest hash of all columns, so which one stays is
    the same in every run.  Rows that are equal in all columns count as copies.  Documents without a word or a doc_id all stay.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), "doc_id", "text", F.xxhash64(*names).alias("tag"))
    made, settled = _grouped(rows)
    able = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    each = made.filter(able).join(settled, "rep").groupBy("component", "doc_id", "tag").agg(F.count("*").alias("times"))
    winners = each.groupBy("component").agg(F.min(F.struct("doc_id", "tag", "times")).alias("w")).select("w.*")
    winners = materialize(winners.unionByName(made.filter((F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()).select("doc_id", "tag", F.lit(0).cast("long").alias("times")).distinct()), "winners")
    out = rows.filter("doc_id IS NOT NULL").join(winners.filter("times < 2").select("doc_id", "tag"), ["doc_id", "tag"], "left_semi").select("row")
    repeated = winners.filter("times > 1")
    if repeated.limit(1).count():
        several = rows.filter("doc_id IS NOT NULL").join(repeated.select("doc_id", "tag"), ["doc_id", "tag"], "left_semi")
        out = out.unionByName(several.groupBy("doc_id", "tag").agg(F.first("row").alias("row")).select("row"))
    return out.unionByName(rows.filter("doc_id IS NULL").select("row")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
