"""Token ids in patched frame-of-reference blocks, and the files that hold them.

One shard file holds the ids of consecutive documents:

    magic "EMBPFOR1"
    groups of up to GROUP blocks, each block BLOCK ids (the last one zero-filled):
        per block: minimum (uint32), width in bits (uint8), exceptions (uint16)
        packed values, block after block: 64 ids of width w fill w 64-bit words
        exceptions, block after block: positions (uint16), then high parts (uint32)
    document index: doc_id (int64), is-null flag (uint8), end offset in ids (uint64)
    block index: start of each group in the file (uint64)
    footer: documents, ids, groups, positions of both indexes (5 x uint64), magic

A block's width is the smallest that holds a chosen percentile of its offsets from
the minimum; what does not fit keeps its low bits in place and its high bits in the
exception list.  All integers are little-endian.

Cases: a null or empty text is its end id alone; equal doc_ids stand in the order of the first LEAD characters of
their texts, then of a hash of them; null doc_ids come first; an empty table gives no shard and no row.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.scratch import fresh, materialize
from emberlog.llm.textnum import Texts, give_back, slices

MAGIC = b"EMBPFOR1"
BLOCK = 256
GROUP = 1024
PERCENTILE = 0.95
CACHE_PIECES = 200_000
CACHE_PARTS = 2_000_000
SHARD_BYTES = 64 << 20
LEAD = 16
TIED = re.compile(r"\s (?:\s|\Z)")  # a space that may belong to the white space on both sides
# Fixed values of byte-level BPE: what plain texts are made of, the classes of their bytes (0: all else), and the
# characters that stand for the 256 bytes: printable ones for themselves, the rest from 256 on.
PLAIN = r"\A[\t-\r -~À-ÖØ-öø-ÿ]*\z"
LETTERS, DIGITS, SPACES = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTERS
KIND[48:58] = DIGITS
KIND[[9, 10, 11, 12, 13, 32]] = SPACES
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = "".join(chr(b if b in _SELF else 256 + [x for x in range(256) if x not in _SELF].index(b)) for b in range(256))
_U64 = np.uint64


# ---------------------------------------------------------------- block coding


def widths(values: np.ndarray, percentile: float = PERCENTILE) -> np.ndarray:
    """Bits that hold the given share of each row's values (rows of uint32)."""
    bits = np.frexp(values.astype(np.float64))[1].astype(np.int8)  # 0 for 0, exact below 2**53
    k = min(values.shape[1] - 1, int(np.ceil(percentile * values.shape[1])) - 1)
    return np.partition(bits, k, axis=1)[:, k].astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) values below 2**width as (n, BLOCK / 64 * width) 64-bit words."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T).astype(np.uint64)
    out = np.zeros((max(width, 1), lanes.shape[1]), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << _U64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> _U64(64 - shift)
    return np.ascontiguousarray(out[:width].T).reshape(len(values), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack: (n, BLOCK) uint32 values."""
    n = len(words)
    if width == 0:
        return np.zeros((n, BLOCK), np.uint32)
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, lanes.shape[1]), np.uint32)
    mask = _U64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = lanes[word] >> _U64(shift)
        if shift + width > 64:
            x = x | (lanes[word + 1] << _U64(64 - shift))
        out[j] = x & mask
    return np.ascontiguousarray(out.T).reshape(n, BLOCK)


def encode_group(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Up to GROUP * BLOCK ids as one group of blocks."""
    blocks = np.zeros((-(-len(ids) // BLOCK), BLOCK), np.uint32)
    blocks.reshape(-1)[: len(ids)] = ids
    if len(ids) % BLOCK:
        blocks[-1, len(ids) % BLOCK :] = blocks[-1, 0]
    low = blocks.min(axis=1)
    rest = blocks - low[:, None]
    wide = widths(rest, percentile)
    over = rest >= (_U64(1) << wide.astype(np.uint64))[:, None]
    counts = over.sum(axis=1).astype(np.uint16)
    row, col = np.nonzero(over)
    high = (rest[row, col].astype(np.uint64) >> wide[row].astype(np.uint64)).astype(np.uint32)
    rest = (rest & ((_U64(1) << wide.astype(np.uint64)) - _U64(1))[:, None].astype(np.uint32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(wide.astype(np.int64) * (BLOCK // 64))])
    words = np.zeros(starts[-1], np.uint64)
    for w in np.unique(wide):
        if w:
            at = np.flatnonzero(wide == w)
            words[starts[at][:, None] + np.arange(int(w) * (BLOCK // 64))] = pack(rest[at], int(w))
    head = np.array([len(blocks)], "<u4").tobytes()
    return b"".join([head, low.astype("<u4").tobytes(), wide.tobytes(), counts.astype("<u2").tobytes(), words.astype("<u8").tobytes(), col.astype("<u2").tobytes(), high.astype("<u4").tobytes()])


def decode_group(raw: bytes) -> np.ndarray:
    """All ids of a group, with the filling of its last block."""
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at = 4
    low = np.frombuffer(raw, "<u4", n, at)
    at += 4 * n
    wide = np.frombuffer(raw, np.uint8, n, at)
    at += n
    counts = np.frombuffer(raw, "<u2", n, at)
    at += 2 * n
    starts = np.concatenate([[0], np.cumsum(wide.astype(np.int64) * (BLOCK // 64))])
    words = np.frombuffer(raw, "<u8", int(starts[-1]), at)
    at += 8 * int(starts[-1])
    total = int(counts.sum())
    col = np.frombuffer(raw, "<u2", total, at)
    high = np.frombuffer(raw, "<u4", total, at + 2 * total)
    out = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(wide):
        rows = np.flatnonzero(wide == w)
        out[rows] = unpack(words[starts[rows][:, None] + np.arange(int(w) * (BLOCK // 64))], int(w))
    row = np.repeat(np.arange(n), counts)
    out[row, col] |= (high.astype(np.uint64) << wide[row].astype(np.uint64)).astype(np.uint32)
    out += low[:, None]
    return out.reshape(-1)


# ---------------------------------------------------------------- shard files


class ShardWriter:
    """Writes one shard; its file appears under its name only when whole."""

    def __init__(self, folder: str, name: str, attempt: int, percentile: float = PERCENTILE):
        self.fs, at = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(at, recursive=True)
        self.part, self.path, self.percentile = f"{at}/.{name}.{attempt}", f"{at}/{name}", percentile
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.at, self.groups, self.ids, self.waiting, self.held = len(MAGIC), [], 0, [], 0
        self.docs: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.nulls.append(nulls.astype(np.uint8))
        self.ends.append((self.ids + np.cumsum(lengths)).astype("<u8"))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= GROUP * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        size = GROUP * BLOCK
        to = len(ids) if last else len(ids) // size * size
        for k in range(0, to, size):
            raw = encode_group(ids[k : min(k + size, to)], self.percentile)
            self.groups.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.waiting, self.held = [ids[to:]], len(ids) - to

    def close(self) -> int:
        """Bytes of the finished file."""
        self._flush(True)
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        docs, nulls, ends = cat(self.docs, "<i8"), cat(self.nulls, np.uint8), cat(self.ends, "<u8")
        index = docs.tobytes() + nulls.tobytes() + ends.tobytes()
        blocks = np.array(self.groups, "<u8").tobytes()
        foot = np.array([len(docs), self.ids, len(self.groups), self.at, self.at + len(index)], "<u8").tobytes() + MAGIC
        self.out.write(index + blocks + foot)
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.at + len(index) + len(blocks) + len(foot)


class ShardReader:
    """Reads a shard group by group; the block index allows a start anywhere."""

    def __init__(self, folder: str, name: str):
        fs, at = pafs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{at}/{name}")
        size = self.file.size()
        foot = self.file.read_at(48, size - 48)
        if foot[40:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{name} is no shard file")
        n, self.n_ids, groups, at_docs, at_blocks = map(int, np.frombuffer(foot, "<u8", 5))
        raw = self.file.read_at(17 * n, at_docs)
        self.docs, self.nulls, self.ends = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.groups = np.append(np.frombuffer(self.file.read_at(8 * groups, at_blocks), "<u8").astype(np.int64), at_docs)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end - 1 of the shard, through the block index."""
        size = GROUP * BLOCK
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // size, (end - 1) // size
        parts = [self.group(k) for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * size : end - first * size]

    def group(self, k: int) -> np.ndarray:
        return decode_group(self.file.read_at(int(self.groups[k + 1] - self.groups[k]), int(self.groups[k])))[: min(GROUP * BLOCK, self.n_ids - k * GROUP * BLOCK)]

    def documents(self, step: int = 1 << 20) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first, last + 1, start, ids) of runs of documents that hold about step ids;
        one longer document is a run of its own."""
        begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        at = 0
        while at < len(self.docs):
            to = max(at + 1, int(np.searchsorted(self.ends, begins[at] + step, side="right")))
            yield at, to, int(begins[at]), self.ids(int(begins[at]), int(self.ends[to - 1]))
            at = to


# ---------------------------------------------------------------- tokenizing


def parts_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the parts that byte-level BPE splits plain texts into, and per text the
    number of its first part (n + 1 values).

    A part is a run of one class: letters, digits, white space or all else.  A space before another class
    belongs to that run; of more white space the last character stands alone (or is that space).  An apostrophe
    that begins a part takes s, t, m, d, re, ve or ll with it.
    """
    data = texts.data
    n = len(data)
    kind = KIND[data]
    text_start = np.zeros(n + 1, bool)
    text_start[texts.offs] = True
    begin = text_start.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    # white space that other characters of the same text follow
    before = np.flatnonzero((kind[:-1] == SPACES) & (kind[1:] != SPACES) & ~text_start[1:n]) if n else np.zeros(0, np.int64)
    begin[before] = True
    begin[before[data[before] == 32] + 1] = False
    # apostrophes that begin a part of their own, and the letters they take
    quote = np.flatnonzero(begin[:n] & (data == 39))
    wide = np.concatenate([data, np.zeros(2, np.uint8)])
    ended = np.concatenate([text_start, np.ones(2, bool)])
    one, two = wide[quote + 1], wide[quote + 2]
    same = ~ended[quote + 1]
    single = same & np.isin(one, list(b"stmd"))
    double = same & ~ended[quote + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
    begin[quote[single | double] + 1] = False
    begin[quote[single] + 2] = True
    begin[np.minimum(quote[double] + 3, n)] = True
    starts = np.flatnonzero(begin[:n])
    return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, texts.offs)


class Known:
    """What is known of parts, by their 64-bit hash: an open-addressing table of numbers, all lookups at once."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        slot = (keys >> _U64(64 - self.bits)).astype(np.int64)
        live = np.arange(len(keys))
        while len(live):
            held = self.numbers[slot]
            hit = self.keys[slot] == keys[live]
            out[live] = np.where(hit, held, -1)
            on = ~hit & (held >= 0)
            live, slot = live[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number new and distinct keys from n on."""
        while 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys[self.numbers >= 0], self.numbers[self.numbers >= 0]
            self.bits += 1
            self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._place(*old)
        self._place(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot = (keys >> _U64(64 - self.bits)).astype(np.int64)
        live = np.arange(len(keys))
        while len(live):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = numbers[live[free]]  # of several for one slot the last one stays
            won = self.numbers[slot] == numbers[live]
            self.keys[slot[won]] = keys[live[won]]
            live, slot = live[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)


class PieceTokenizer:
    """A byte-level BPE tokenizer that remembers the ids of parts.

    Plain texts (ASCII, Latin-1 letters) are split here, all at once in numpy, as the tokenizer's own pattern
    splits them; each new part goes to the library's BPE model once.  Parts are known by a 64-bit hash
    of their bytes.  All other texts are cut before a space that has a character other than
    white space on either side, where the pattern always cuts; the pieces go to the library whole and are remembered too.  A
    text that holds the string of a special token goes to the library as it is.
    """

    def __init__(self, path: str, end_id: int = 0):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.bpe = self.model.model
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        """Drop what is known of parts and pieces; the model stays."""
        self.known = Known()
        self.pieces_of: dict[str, list[int]] = {}
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 1
        self.pool[0] = self.end_id
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    @staticmethod
    def pieces(text: str) -> list[str]:
        parts = text.split(" ")
        out = parts[:1] + [" " + p for p in parts[1:]]
        if not TIED.search(text):
            return [p for p in out if p]
        joined: list[str] = []
        for k, p in enumerate(out):
            if k and joined and not ((parts[k - 1] and not parts[k - 1][-1].isspace()) or (parts[k] and not parts[k][0].isspace())):
                joined[-1] += p
            elif p:
                joined.append(p)
        return joined

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        every: list[int] = []
        sizes = np.zeros(len(parts), np.int64)
        n, tokenize = self.known.n, self.bpe.tokenize
        for k, part in enumerate(parts):
            ids = tokenize(part.decode("latin-1").translate(BYTE_CHARS))
            sizes[k] = len(ids)
            every += [t.id for t in ids]
        while n + len(parts) > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.used + len(every) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.pool[self.used : self.used + len(every)] = every
        self.sizes[n : n + len(parts)] = sizes
        self.starts[n : n + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(every)
        self.known.add(keys)

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = Texts(column)
        starts, ends, first = parts_of(texts)
        keys = texts.hashes(starts, ends)
        if self.known.n > CACHE_PARTS:
            self.forget()
        which = self.known.find(keys)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            new, at, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            raw = memoryview(np.ascontiguousarray(texts.data))
            at = missing[at]
            n = self.known.n
            self._learn(new, [bytes(raw[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            which[missing] = n + back
        # the end id is one more part after those of each text
        lengths, begins = np.insert(self.sizes[which], first[1:], 1), np.insert(self.starts[which], first[1:], 0)
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(ends[first[1:] + np.arange(len(texts))], prepend=0)

    def _other(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return [*self.model.encode(text, add_special_tokens=False).ids, self.end_id]
        pieces = self.pieces(text)
        if len(self.pieces_of) > CACHE_PIECES:
            self.pieces_of.clear()
        new = list({p for p in pieces if p not in self.pieces_of})
        for piece, found in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False)):
            self.pieces_of[piece] = found.ids
        return [*itertools.chain.from_iterable(map(self.pieces_of.__getitem__, pieces)), self.end_id]

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with its end id, and how many each has."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = pc.invert(pc.match_substring_regex(column, PLAIN))
        for content in self.special:
            odd = pc.or_(odd, pc.match_substring(column, content))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        if not odd.any():
            return self._plain(column)
        plain, lengths = self._plain(column.filter(pa.array(~odd)))
        own = [np.array(self._other(t), np.uint32) for t in column.filter(pa.array(odd)).to_pylist()]
        sizes = np.zeros(len(column), np.int64)
        sizes[~odd], sizes[odd] = lengths, [len(x) for x in own]
        ids = np.empty(int(sizes.sum()), np.uint32)
        from_odd = np.repeat(odd, sizes)
        ids[~from_odd], ids[from_odd] = plain, np.concatenate(own)
        return ids, sizes


@functools.lru_cache(maxsize=1)
def tokenizer(path: str, end_id: int) -> PieceTokenizer:
    """One tokenizer for all tasks of a worker, so that its model is read once."""
    return PieceTokenizer(path, end_id)


# ---------------------------------------------------------------- operators


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, percentile: float = PERCENTILE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Tokenize docs (doc_id, text) into shard files in ascending doc_id order.

    Returns the manifest, one row per shard: shard, name, n_docs, n_tokens, n_bytes.  A task
    that runs again writes its own file and then takes the name: a lost executor or a second
    attempt leaves the same file.
    """
    spark = docs.sparkSession
    seen = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-min(seen, 1 << 50) // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, name, out, n, tokens = context.partitionId(), f"shard-{context.partitionId():08d}.pfor", None, 0, None
        for batch in slices(batches):
            if out is None:
                out, tokens = ShardWriter(folder, name, context.taskAttemptId(), percentile), tokenizer(tokenizer_path, end_id)
            ids, lengths = tokens.encode(batch.column(1))
            keys = batch.column(0)
            out.add(keys.fill_null(0).to_numpy(), np.asarray(keys.is_null()), ids, lengths)
            n += batch.num_rows
        if out is not None:
            tokens.forget()  # else it stays in a worker that other stages use
            give_back()
            total, size = out.ids, out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *map(pa.array, ([name], [n], [total], [size]))], names=["shard", "name", "n_docs", "n_tokens", "n_bytes"])

    # short keys, as the bounds of ranges come from keys that are sent to the driver
    keys = ["doc_id", "lead", "print"]
    dealt = docs.select("doc_id", "text", F.substring("text", 1, LEAD).alias("lead"), F.xxhash64("text").alias("print")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")
    return materialize(dealt.mapInArrow(run, "shard int, name string, n_docs long, n_tokens long, n_bytes long"), "manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    based = manifest.select("shard", "name", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("base"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                file = ShardReader(folder, name)
                for at, to, start, ids in file.documents():
                    ends = file.ends[at:to]
                    begins = np.concatenate([[start], ends[:-1]])
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    crc = [zlib.crc32(raw[4 * (a - start) : 4 * (b - start)]) for a, b in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(file.docs[at:to], pa.int64(), mask=file.nulls[at:to].astype(bool)), pa.array(begins + base, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartition(parts, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write the shards (to the shared folder unless told where) and index them from the files."""
    folder = folder or fresh(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, tokenizer_path, folder), folder)
