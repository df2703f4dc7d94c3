from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from emberlog.llm import mixing
from emberlog.llm.scratch import Scratch


def balanced(cells, targets):
    """Rates by halving on the profile of the dual: cells {(source, class): mass}."""
    tokens = sum(cells.values())
    middle = sum(m * c for (_, c), m in cells.items()) / tokens
    held = defaultdict(list)
    for (s, c), m in cells.items():
        held[s].append((c - middle, m))
    size = {s: sum(m for _, m in v) for s, v in held.items()}
    free = [s for s in held if 0 < targets[s] < 3 * size[s]]

    def tilt(s, x, own, shared):
        return 0.0 if targets[s] <= 0 else min(3.0, math.exp(own[s] + shared * x)) if s in own else 3.0

    def halved(below, lo, hi):
        for _ in range(60):
            lo, hi = ((lo + hi) / 2, hi) if below((lo + hi) / 2) else (lo, (lo + hi) / 2)
        return lo

    def profile(shared):
        return {s: halved(lambda v: sum(m * min(3.0, math.exp(v + shared * x)) for x, m in held[s]) < targets[s], -30.0, 30.0) for s in free}

    def slope(shared):
        own = profile(shared)
        return sum(m * tilt(s, x, own, shared) * x for s in held for x, m in held[s]) + mixing.SOFT * tokens * shared

    shared = halved(lambda v: slope(v) < 0, -5.0, 5.0)
    own = profile(shared)
    return {(s, c): tilt(s, c - middle, own, shared) for s, c in cells}


def shared_out(size):
    """Targets by resharing, as the contract words it."""
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        if not rest:
            return {s: 3.0 * size[s] for s in names}
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] > 3 * size[s]}
        if not over:
            return {s: 3.0 * size[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def corpus():
    r = np.random.default_rng(5)
    rows = []
    for k in range(900):
        s = ["web", "web", "web", "book", "b", None, "Z", "empty"][k % 8]
        n = 0 if s == "empty" else int(r.lognormal({"web": 3, "book": 6, "b": 2}.get(s, 4), 1))
        rows.append((None if k % 97 == 0 else k, None if n == 0 and k % 2 else " ".join(["w"] * n), s, k % 5, "c"))
    return rows + rows[40:60] + [(7000, "x y " * 60_000, "web", 1, "c")]


def test_targets_rates_and_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, copies string")
    size, cells = Counter(), Counter()
    for _, t, s, *_ in rows:
        n = len((t or "").split())
        size[s] += n
        cells[s, max(n, 1).bit_length() - 1] += n
    targets = shared_out(size)
    want = balanced(cells, targets)
    got = mixing.mix(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"]) for r in got) == sorted((-1 if d is None else d, len((t or "").split())) for d, t, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
        taken[r.source_size, round(r.target, 3)] += r.taken
    for s in size:
        assert abs(taken[size[s], round(targets[s], 3)] - targets[s]) <= max(0.05 * targets[s], 130_000 if s == "web" else 400), s
    scratch = Scratch(spark)
    made = mixing._cells(docs.select("source", mixing.size_of(docs["text"]).alias("size")))
    by = mixing.targets(made, scratch)
    assert {r["source"]: r["target"] for r in by.collect()} == pytest.approx(targets)
    rates = {(r["source"], r["class"]): r["rate"] / mixing.UNIT for r in mixing.rates(made, by, scratch).collect()}
    assert rates.keys() == want.keys()
    for key, value in want.items():
        assert rates[key] == pytest.approx(value, abs=2e-5), key
    assert len({round(v, 3) for (s, _), v in rates.items() if s == "web"}) > 1  # documents of one source differ


def test_mixture_keeps_columns_and_counts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, copies string")
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    first, again = Counter(map(tuple, out.collect())), Counter(map(tuple, mixing.mixture(docs.repartition(5)).collect()))
    assert first == again and set(first) <= {tuple(r) for r in rows}
    times = Counter(rows)
    assert all(n <= 3 * times[r] for r, n in first.items())
    words = sum(len((t or "").split()) * n for (_, t, *_), n in first.items())
    assert words == sum(r.taken for r in mixing.mix(docs).collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, "  ", "b")], [(1, "one two", "a")], [(1, "one two", "a"), (1, "one two", "a"), (2, "x", "b")]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mixture(docs).count() == sum(r.copies for r in got)
