"""What a Python worker still holds when a stage is over: the next stage runs in the same worker."""

from __future__ import annotations

import ctypes
import subprocess
import sys

import pyarrow as pa
import pytest

from emberlog.llm import tokenfile
from emberlog.llm.registry import tokenizer_path

HELD = """
import random, re
import pyarrow as pa
from emberlog.llm.neardup import shingle_sets
from emberlog.llm.textnum import Texts, slices

def mb():
    return sum(map(int, re.findall(r"\\nPrivate_Dirty:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

r = random.Random(5)
base = " ".join("%d" % r.randrange(10**6) for _ in range(600_000))
batches = (pa.RecordBatch.from_arrays([pa.array([base[k * 400 : k * 400 + 3000] for k in range(n, n + 5000)])], names=["text"]) for n in (0, 2500, 5000))
shingle_sets(Texts(pa.array(["a b c d e f"])))  # tables of powers, which last
began = mb()
for piece in slices(batches):
    shingle_sets(Texts(piece.column(0)))
del piece
print(mb() - began)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux") or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="reads /proc; glibc only")
def test_pieces_leave_little_behind():
    said = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=tokenfile.__file__.rpartition("/emberlog/")[0])
    print(said.stdout)
    assert float(said.stdout) < 30


def test_workers_forget_parts(spark):
    texts = [(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(200)]
    out = tokenfile.token_index(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer_path())
    assert out.count() == 200
    path, tokenizer = tokenizer_path(), tokenfile.tokenizer

    def held(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([tokenizer(path, 0).known.n])], names=["n"])

    assert {r["n"] for r in spark.range(16).repartition(8).mapInArrow(held, "n long").collect()} == {0}
