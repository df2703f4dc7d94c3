from __future__ import annotations

import random

import corpus_pipeline


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    r = random.Random(12)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ne", "su", "ra", "ti", "vo"]) for _ in range(r.randrange(1, 5)))
    item = [word() for _ in range(30)]
    docs = []
    for d in range(120):
        body = [word() for _ in range(r.randrange(40, 120))]
        if d % 10 == 3:
            body[5:5] = item
        docs.append([d, " ".join(body), "en", f"s{d % 4}" if d % 7 else None, 1])
    docs.append([200, docs[0][1], "en", "s1", 1])  # a copy of 0
    docs.append([201, docs[1][1] + " and more", "en", "s1", 1])  # a near copy of 1
    docs.append([202, "too short", "en", "s1", 1])
    docs.append([203, None, "en", "s1", 1])
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names, kept, held = ["doc_id", "text", "lang", "source", "n_chars"], [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.materialize(stage(spark, held, str(tmp_path)), "t")
        assert held.columns == names
        kept.append({x.doc_id for x in held.collect()})
    clean = set(range(120))
    assert kept[0] == clean | {200, 201}
    assert kept[1] == clean
    assert kept[2] == {d for d in clean if d % 10 != 3}
    rows = held.collect()
    words = lambda xs: sum(len(x.text.split()) for x in xs)
    before = [x for x in docs if x[0] in kept[2]]
    assert abs(words(rows) / sum(len(x[1].split()) for x in before) - 1) < 0.2
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert [x.doc_id for x in out] == sorted(x.doc_id for x in rows)
    at = 0
    for x in out:
        assert x.start == at
        at += x.n_tokens


def test_rerun_agrees(spark, tmp_path):
    docs = [(d, " ".join(f"w{(d * 7 + k) % 97}q{k}" for k in range(30 + d)), "en", f"s{d % 3}", 1) for d in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this kind here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda: sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert run() == run()
