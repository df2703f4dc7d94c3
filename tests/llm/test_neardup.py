from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from emberlog.llm import neardup
from emberlog.llm.textnum import Texts


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Per row (doc_id, size, component_id, kept)."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                group[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [(d, len(s), least.get(find(k)), least.get(find(k)) == d) for k, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 6)))
    fresh = lambda n: [word() for _ in range(n)]
    rows = [(None, "a b c d e f g"), (None, None), (1, None), (2, ""), (3, " "), (4, "a b"), (5, "A  b"), (6, "a b c")]
    for g in range(25):
        base = fresh(r.randrange(6, 120))
        for _ in range(r.randrange(1, 9)):
            body = list(base)
            for _ in range(r.randrange(0, 3)):
                body[r.randrange(len(body))] = word()
            rows.append((len(rows) + 100, " ".join(body)))
    rows += [(d + 3000, t) for d, t in rows[20:50]]  # exact copies
    rows += [(7, rows[30][1]), (7, " ".join(fresh(40))), (7, " ".join(fresh(40))), rows[40], rows[40]]  # one id, several texts; repeated rows
    shared = fresh(60)
    rows += [(5000 + k, " ".join(shared + fresh(60))) for k in range(80)]  # half of each is boilerplate: no links
    rows += [(6000 + k, " ".join(shared[:50] + [f"z{k}"])) for k in range(60)]  # one large group
    rows += [(9000, " ".join(fresh(50_000)))]
    return rows


def test_equals_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, rep long, tag long")
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.classify(df).collect()), key=key)
    want = sorted(((d, n, c if n and d is not None else d, k or not n or d is None) for d, n, c, k in brute(rows)), key=key)
    assert got == want


def test_blocks_give_the_same_links(spark, monkeypatch):
    rows = corpus()[8:140]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: sorted(map(tuple, neardup.classify(df).collect()))
    whole = run()
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "CHUNK", 2)
    assert run() == whole


def test_no_text_is_lost(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, d, t, "x") for k, (d, t) in enumerate(rows)], "component long, doc_id long, text string, row string")
    out = neardup.deduplicate(df)
    assert out.columns == df.columns
    kept = [rows[r.component] for r in out.collect()]
    assert [tuple(r) for r in neardup.deduplicate(df.repartition(3)).orderBy("component").collect()] == [tuple(r) for r in out.orderBy("component").collect()]
    stay = brute(rows)
    groups = {(c, s) for (_, n, c, _), s in zip(stay, map(shingles, (t for _, t in rows))) if n and c is not None}
    # each component has one document, which has its smallest id; documents without words or id all stay
    assert sum(d is None or not shingles(t) for d, t in kept) == sum(d is None or not shingles(t) for d, t in rows)
    ids = sorted(d for d, t in kept if d is not None and shingles(t))
    assert set(ids) == {c for c, _ in groups}
    assert ids.count(7) == sum(1 for d, t in kept if d == 7 and shingles(t)) >= 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classify(df).count() == neardup.deduplicate(df).count() == 0


def test_estimates_are_near_the_similarity():
    r = np.random.default_rng(0)
    for share in (0.3, 0.75, 0.95):
        off = []
        for _ in range(30):
            words = [f"w{x}" for x in r.integers(0, 1 << 40, 400)]
            cut = int(400 * (1 - share) / (1 + share))
            a, b = words[: 400 - cut], words[cut:]
            hashes, bounds = neardup.shingle_sets(Texts(pa.array([" ".join(a), " ".join(b)])))
            both = neardup.sketches(hashes, bounds)
            true = len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b)))
            off.append(float(neardup.estimate(both[:1], both[1:])[0]) - true)
        assert abs(np.mean(off)) < 0.04 and np.std(off) < 0.08
