from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from emberlog.llm import tokenfile
from emberlog.llm.registry import tokenizer_path


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("high", [1, 2, 200, 50_257, 1 << 31, (1 << 32) - 1])
@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_group_round_trip(n, high):
    r = np.random.default_rng(n)
    ids = r.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[r.random(n) < 0.03] = high
    assert (tokenfile.decode_group(tokenfile.encode_group(ids))[:n] == ids).all()


def test_outliers_go_to_the_exception_list():
    ids = np.full(tokenfile.BLOCK, 7, np.uint32)
    ids[3] = 4_000_000_000
    raw = tokenfile.encode_group(ids)
    assert len(raw) < 40 and (tokenfile.decode_group(raw) == ids).all()


ALPHABET = ["a", "B", "é", "ÿ", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\u3000", "\x1c", "\x85", "9", "٣", "½", "!", "'", "'s", "'re", "'ll", "'ve", "'S", "’s", "the", "ß", "中", "😀", "e\u0301", "ª", "×", "_", "#", "<|endoftext|>", "\x00", "\u200d"]


def whole(model, texts):
    return [[*model.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def cut(ids, sizes):
    ends = np.cumsum(sizes)
    assert ends[-1] == len(ids)
    return [ids[a:b].tolist() for a, b in zip(ends - sizes, ends)]


def test_ids_of_whole_texts(model):
    """Random Unicode, special strings included, against whole-text calls of the untouched library."""
    t = tokenfile.PieceTokenizer(tokenizer_path())
    r = random.Random(5)
    texts = ["", " ", "  ", "a  ", "a\n ", "\n \n", " \n a", "a   b", "<|endoftext|> x", "a\n <|endoftext|>  ", "don't  we'll", "'s", "'", "x'", "x're", "x'r", "''s", " 's", "\n's", "'s's5", "'lls"]
    texts += ["".join(r.choice(ALPHABET) for _ in range(r.randrange(30))) for _ in range(6000)]
    plain = [a for a in ALPHABET if len(a) > 1 or a in "aBéÿ \n\t9!'ß_#"]
    plain.remove("<|endoftext|>"), plain.remove("’s"), plain.remove("e\u0301")
    texts += ["".join(r.choice(plain) for _ in range(r.randrange(30))) for _ in range(6000)]
    texts += ["".join(chr(r.choice((r.randrange(1, 0x250), r.randrange(1, 0xD800), r.randrange(0xE000, 0x110000)))) for _ in range(r.randrange(12))) for _ in range(4000)]
    for texts in (texts, texts[::-1]):
        assert cut(*t.encode(texts)) == whole(model, texts)


def test_parts_join_to_the_text_and_texts_stay_apart():
    import pyarrow as pa

    texts = tokenfile.Texts(pa.array(["a b", " ", "", "b's", "s it"]))
    starts, ends, first = tokenfile.parts_of(texts)
    got = [[texts.data[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    assert got == [["a", " b"], [" "], [], ["b", "'s"], ["s", " it"]]


def test_forgetting_parts_keeps_ids(model, monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE_PARTS", 3)
    monkeypatch.setattr(tokenfile, "CACHE_PIECES", 2)
    t = tokenfile.PieceTokenizer(tokenizer_path())
    for text in ["one two three four five", "six seven", "one six", "ein – zwei – drei", "zwei – vier"]:
        assert cut(*t.encode([text])) == whole(model, [text])


def test_known_parts_table():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2))
    held = tokenfile.Known(2)
    for at in range(0, len(keys), 7001):
        held.add(keys[at : at + 7001])
    assert (held.find(keys) == np.arange(len(keys))).all() and (held.find(keys + np.uint64(1)) == -1).all()


def test_index_from_files(spark, model):
    rows = [(5, "five words are in here"), (1, None), (3, ""), (2, "a b " * 4000), (7, "ab cd " * 700_000), (None, "no id"), (5, "five words are in here"), (5, "another five")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, name string")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.token_index(docs, tokenizer_path()).collect())
    start, expected = 0, []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    empty = docs.limit(0)
    assert tokenfile.token_index(empty, tokenizer_path()).count() == 0


def test_random_access(tmp_path):
    w = tokenfile.ShardWriter(f"file://{tmp_path}", "s", 0)
    ids = np.arange(700_000, dtype=np.uint32) % 50_000
    w.add(np.array([1, 2]), np.array([0, 0]), ids, np.array([300_000, 400_000]))
    w.close()
    r = tokenfile.ShardReader(f"file://{tmp_path}", "s")
    for a, b in ((0, 1), (262_143, 262_145), (1000, 600_000), (699_999, 700_000), (5, 5)):
        assert (r.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        pafs.LocalFileSystem().copy_file(f"{tmp_path}/s", f"{tmp_path}/t")
        with open(f"{tmp_path}/t", "r+b") as f:
            f.seek(-1, 2)
            f.write(b"x")
        tokenfile.ShardReader(f"file://{tmp_path}", "t")
