from __future__ import annotations

import random

import numpy as np

from emberlog.llm import decontam


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    top = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            top = max(top, h[i][j])
    return top


def test_alignment_equals_the_plain_recurrence():
    r = np.random.default_rng(3)
    sizes = r.integers(1, 12, 200)
    items = r.integers(1, 5, (200, 12)).astype(np.uint64)
    items[np.arange(12) >= sizes[:, None]] = 0
    passages = r.integers(0, 5, (200, 20)).astype(np.uint64)
    best, start, stop = decontam.align(items, sizes, passages)
    for k in range(200):
        a, b = items[k, : sizes[k]].tolist(), [x or -1 for x in passages[k].tolist()]
        assert best[k] == smith_waterman(a, b)
        assert not best[k] or smith_waterman(a, b[start[k] : stop[k]]) == best[k]


def test_copies_and_edits_are_found_and_clean_texts_left(spark):
    r = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "to", "su", "vi") for c in ("x", "n", "st", "")]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, text(r.randrange(16, 60))) for k in range(20)]
    docs, planted = [], set()
    for d in range(300):
        body = text(r.randrange(30, 300))
        if d % 3 == 0:
            k, item = r.choice(items)
            copy = [w if r.random() > 0.1 or d % 2 else r.choice(vocabulary) for w in item]
            at = r.randrange(len(body))
            body[at:at] = copy
            planted.add((d, k))
        docs.append((d, "  ".join(w.upper() if d % 5 else w + "," for w in body), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "one two", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(50, None), (51, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontam.matches(df, bench).collect()}
    assert set(got) == planted
    assert all(got[p].score == 1.0 for p in planted if p[0] % 2)
    assert decontam.decontaminate(df, bench).count() == len(docs) - len({d for d, _ in planted})
    assert decontam.matches(df.limit(0), bench).count() == 0 and decontam.matches(df, bench.limit(0)).count() == 0


def test_long_insertions_and_deletions_score_as_over_the_whole_document(spark):
    r = random.Random(21)
    vocabulary = [f"{a}{b}{k}" for a in ("ka", "lo", "mi") for b in ("ra", "to", "su") for k in range(60)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (59, 40, 30, 24, 16, 80)]
    docs = []
    for k, item in enumerate(items):
        n = len(item)
        for put in (0, n // 4, 3 * n // 7, 4 * n // 5, 6 * n // 7):
            docs.append(text(40) + item[: n // 2] + text(put) + item[n // 2 :] + text(40))
            docs.append(text(30) + item[: n // 3] + text(put // 2) + item[n // 3 : n // 2] + text(put // 3) + item[n // 2 :])
        docs.append(text(10) + item[: n // 3] + item[n // 2 :] + text(10))
        docs.append(item[: n // 3] + text(5000) + item[n // 3 :] + text(3000) + item)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    want = {}
    for d, body in enumerate(docs):
        for k in range(len(items)) if len(body) < 1000 else [d // 12]:
            score = smith_waterman(items[k], body) / (2 * len(items[k]))
            if score >= decontam.THRESHOLD:
                want[d, k] = score
    got = {(x.doc_id, x.item_id): x.score for x in decontam.matches(df, bench).collect()}
    assert got == want and len(want) > 50


def test_short_items_are_their_own_seed(spark):
    docs = [(1, "here Granite Falls ends"), (2, "granite and falls"), (3, "a xylophone"), (4, "granite falls granite falls"), (4, "granite falls granite falls"), (None, "granite falls"), (5, None), (6, "")]
    bench = [(1, "granite falls"), (2, "Xylophone!"), (3, "granite and falls"), (1, "nothing else"), (4, None)]
    df = spark.createDataFrame([(d, t, 1.0, 7) for d, t in docs], "doc_id long, text string, score double, first_word long")
    got = {(x.doc_id, x.item_id): x.score for x in decontam.matches(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    whole = {(d, k): 1.0 for d, k in ((1, 1), (3, 2), (4, 1), (None, 1), (2, 3))}
    assert {p: s for p, s in got.items() if s == 1.0} == whole
    assert decontam.decontaminate(df, spark.createDataFrame(bench, "item_id long, text string")).columns == df.columns


def test_recall_against_full_alignment_with_common_words(spark):
    r = random.Random(77)
    vocabulary = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    text = lambda n: r.choices(vocabulary, weights, k=n)
    items = [text(r.randrange(12, 40)) for _ in range(16)]
    docs = []
    for d in range(160):
        body = text(r.randrange(20, 120))
        if d % 2:
            rate = r.choice((0.0, 0.1, 0.2, 0.3))
            body[len(body) // 2 : len(body) // 2] = [w if r.random() > rate else r.choice(vocabulary) for w in r.choice(items)]
        docs.append(body)
    want = {(d, k) for d, body in enumerate(docs) for k, item in enumerate(items) if smith_waterman(item, body) >= decontam.THRESHOLD * 2 * len(item) - 1e-9}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.matches(df, spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 60, (len(got), len(want))


def test_seed_places_in_pieces_give_the_same_passages(monkeypatch):
    import pyarrow as pa

    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)]
    items = decontam.Items.of(list(range(30)), [" ".join(r.choices(vocabulary, k=r.randrange(1, 9))) for _ in range(30)])
    words, first = decontam.words_of(decontam.Texts(pa.array([" ".join(r.choices(vocabulary, k=r.randrange(200))) for _ in range(20)])))
    whole = decontam._passages(items, words, first, 0.55)
    monkeypatch.setattr(decontam, "HITS", 5)
    for a, b in zip(whole, decontam._passages(items, words, first, 0.55)):
        assert (a == b).all()
    assert len(whole[0]) > 50


def test_every_two_following_grams_keep_one():
    r = np.random.default_rng(1)
    block = decontam.Items.of([1, 2], [" ".join(f"a{k}" for k in range(50)), "x y z"])
    for _ in range(20):
        kept = decontam.rare_seeds(block, r.integers(5, 9, len(block.grams)), 10)
        at = np.sort(kept.place[kept.item == 0])
        assert at[0] <= 1 and at[-1] >= 46 and (np.diff(at) <= 2).all() and (kept.item == 1).any()
