"""Pieces of batches: how much text a worker holds at once, and what it makes of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from emberlog.llm.neardup import shingle_sets
from emberlog.llm.textnum import Texts, slices


def test_pieces_are_small_and_change_no_result():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 900, int(n)))) for n in rng.integers(0, 4000, 400)] + [None, "", "x " * (1 << 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    pieces = list(slices([batch]))
    assert pa.Table.from_batches(pieces).column(0).to_pylist() == texts
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 1 << 20 for p in pieces)
    whole, bounds = shingle_sets(Texts(batch.column(0)))
    parts = [shingle_sets(Texts(p.column(0))) for p in pieces]
    assert np.array_equal(np.concatenate([h for h, _ in parts]), whole)
    assert np.array_equal(np.concatenate([np.diff(b) for _, b in parts]), np.diff(bounds))
