from __future__ import annotations

import hashlib
import random

import pyarrow as pa

from emberlog.llm import exactsub


def brute(rows):
    first = {}
    big = exactsub.LAST
    for d, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            s = raw[k : k + 50]
            first[s] = min(first.get(s, big), big if d is None else d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < (big if d is None else d):
                gone[k : k + 50] = [True] * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if d is None else d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, tag string")
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exactsub.deduplicate(df).collect())


def test_equals_brute_force(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(r.randrange(8, 40))) for _ in range(12)]
    rows = [(0, "a" * 300), (1, "a" * 60), (2, "ab" * 100), (3, "a" * 49), (4, None), (5, ""), (6, "ab" * 30 + "a" * 80)]
    for d in range(10, 150):
        parts = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            parts.append(p[a : a + r.randrange(120)] if r.random() < 0.5 else p if r.random() < 0.5 else " ".join(word() for _ in range(20)))
        rows.append((d, (" " if d % 2 else "\n").join(parts)))
    rows += [(d + 1000, t) for d, t in rows[20:60]] + [(70, rows[30][1]), (70, rows[31][1]), (12, rows[12][1]), (None, rows[40][1]), (None, "z" * 70), (-7, passages[3])]
    r.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_a_reach_that_repeats_in_its_first_document(spark):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    p = text(120)
    rows = [(5, p + text(30) + p + text(30) + p), (3, text(40) + p[20:90] + text(40)), (9, p)]
    assert run(spark, rows) == brute(rows)


def test_scratch_lies_in_few_files_and_results_stay(spark, monkeypatch):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    p = [text(150) for _ in range(6)]
    rows = [(d, text(30) + p[d % 6][d % 40 : 90 + d % 60] + text(20) + p[d % 5]) for d in range(80)]
    keep, files = exactsub.materialize, {}

    def counted(df, label, **more):
        out = keep(df, label, **more)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(exactsub, "materialize", counted)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert run(spark, rows) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(files) == {"live", "reaches", "strings", "pieces"}
    assert all(n <= 8 for label, n in files.items() if label != "pieces"), files
    assert files["pieces"] <= 16, files  # those of two tables


def test_empty_table(spark):
    assert run(spark, []) == []


def test_ranking_does_not_depend_on_batches():
    r = random.Random(8)
    table = sorted((r.randrange(40), r.randrange(3), r.randrange(6), r.randrange(2), k << 8 | 60) for k in range(600))
    cols = [[t[k] for t in table] for k in (2, 3, 4, 0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "tag", "span", "gram", "whole"])
    seen = set()
    for size in (1, 2, 7, 600):
        out = [x for b in exactsub._ranked(batch.slice(k, size) for k in range(0, 600, size)) for x in b.to_pylist()]
        seen.add(tuple(sorted((x["span"], x["whole"] is None, x["first"]) for x in out if x["whole"] is not None or not x["first"])))
    assert len(seen) == 1
    head = {}
    for g, w, d, _, _ in table:
        head[g, w] = min(d, head.get((g, w), d))
    reaches = {g: sum(k[0] == g for k in head) for g in range(40)}
    want = {(s, d > head[g, w]) for g, w, d, _, s in table if d > head[g, w] or reaches[g] > 1}
    assert {(s, null) for s, null, _ in seen.pop()} == want
