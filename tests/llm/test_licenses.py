from __future__ import annotations

import random
import re

from emberlog.llm import licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_base_equals_brute_force(spark):
    r = random.Random(4)
    bits = ["MIT", "License", "cc", "BY", "apache", "gnu", "general", "public", "license", "é", "😀", "-", "\n", " ", "x", "licens", ",", "cc by cc by"]
    texts = [None, "", " ", "mit license", "mit license mit license", "gnu general public license apache license"] + [" ".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)], "doc_id long, text string, name string")
    for row in licenses.scan(df).collect():
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == brute(texts[row.doc_id]), texts[row.doc_id]
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1


def test_edited_notices_are_found_with_their_spans(spark):
    r = random.Random(9)
    rows = []
    for k, (notice, label) in enumerate(licenses.NOTICES):
        text = notice
        for _ in range(licenses.allowed(notice)):
            at = r.randrange(1, len(text) - 1)
            text = text[:at] + r.choice(["", "x", text[at] + "q"]) + text[at + 1 :]
        rows.append((k, "Before é, " + text.upper() + " after all", label))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()
    found = sum(rows[g.doc_id][2] in g.labels.split(",") for g in got)
    assert found >= len(rows) - 1
    span = licenses.scan(spark.createDataFrame([(1, "é The M.I.T! (Mit  Licence) end")], "doc_id long, text string")).first().spans[0]
    assert (span.label, "é The M.I.T! (Mit  Licence) end"[span.start : span.end], span.edits) == ("mit", "Mit  Licence", 1) or span.edits <= 1


def test_plain_texts_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "The permit was licensed and read by all right people in general public")], "doc_id long, text string")
    assert licenses.scan(df).first().labels == ""
    assert licenses.scan(df.limit(0)).count() == 0


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_fuzzy_equals_all_word_stretches():
    r = random.Random(12)
    few = tuple(x for x in licenses.NOTICES if len(x[0]) < 30)
    texts = ["mit licenses", "amit license", "mit licence or mit license", "mit licence and permit licenses", "mit license mit license", "mit licens mit license", ""]
    for _ in range(150):
        words = []
        for _ in range(r.randrange(1, 4)):
            notice = list(r.choice(few)[0])
            for _ in range(r.randrange(3)):
                at = r.randrange(len(notice))
                notice[at] = r.choice(["", "x", notice[at] + "s", " ", "l"])
            words += ["".join(notice), *r.choices(["the", "a", "mit", "license", "é"], k=r.randrange(3))]
        texts.append(" ".join(" ".join(words).split()))
    some = 0
    for text in texts:
        starts = [k for k in range(len(text)) if text[k] != " " and (k == 0 or text[k - 1] == " ")]
        ends = [k for k in range(1, len(text) + 1) if text[k - 1] != " " and (k == len(text) or text[k] == " ")]
        want = []
        for notice, label in few:
            most = licenses.allowed(notice)
            near = [(distance(notice, text[a:b]), a, b) for a in starts for b in ends if abs(b - a - len(notice)) <= most]
            taken = []
            for edits, a, b in sorted(near):
                if edits <= most and all(b <= c or d <= a for c, d in taken):
                    taken.append((a, b))
                    want.append((a, b, label, edits))
        assert licenses.fuzzy(text, few) == sorted(want), text
        some += len(want)
    assert some > 150
    assert [x[:2] for x in licenses.fuzzy("mit licence or mit license") if x[2] == "mit"] == [(0, 11), (15, 26)]


def test_long_and_repeated_texts(spark):
    import time

    long = "cc by, MIT licence " * 60_000
    began = time.perf_counter()
    assert [k for k, _ in licenses.exact(b" ".join(licenses.normal(long)))][:3] == [0, 4, 8]
    assert time.perf_counter() - began < 2
    rows = [(1, long), (1, long), (None, "mit license"), (2, "cc  by")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.labels, len(r.spans)) for r in got) == [(0, 2, 1, 0, 0, "mit", 1), *[(1, 240_000, 60_000, 0, 239_996, "cc-by,mit", 60_000)] * 2, (2, 2, 1, 0, 0, "cc-by", 0)]
