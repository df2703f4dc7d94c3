from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from emberlog.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup, rep = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    failed = n < 10 or 100 * rep > 20 * n
    return (n, chars, symbols, dup, rep, failed, not (failed or 4 * symbols > n or 20 * dup > n or chars < 2 * n or chars > 30 * n))


def texts():
    r = random.Random(4)
    words = ["a", "bb", "é", "#", "中文字", "word", "$5", "x" * 40]
    out = [None, "", " ", "\n\n", "one two", "same line here\n" * 12, "a b c d e f g h i j k", "# " * 30, "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z"]
    out += ["".join(r.choice(words) + r.choice([" ", " ", "\n", "\t"]) for _ in range(r.randrange(60))) for _ in range(150)]
    out += [" ".join(f"w{r.randrange(10**6)}" for _ in range(30_000)), " ".join(f"w{k}" for k in range(40))]
    return out + out[9:20]


def test_equals_brute_force(spark):
    rows = [(k if k % 7 else None, t, k, "n", k) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, kept string, rejected_by long")
    got = sorted(tuple(r)[1:-1] for r in quality.measure(docs).collect())
    assert got == sorted(brute(t) for _, t, *_ in rows)
    assert got
    kept = [k for k, (_, t, *_) in enumerate(rows) if brute(t)[-1]]
    assert sorted(r["n_words"] for r in quality.cascade(docs).collect()) == kept
    said = quality.cascade(docs, keep=False)
    assert said.columns == ["doc_id", "text", "n_words", "kept", "rejected_by"]
    assert sorted(r["n_words"] for r in said.filter("rejected_by IS NULL").collect()) == kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.measure(docs).count() == quality.cascade(docs).count() == 0


def test_later_rules_see_only_survivors():
    seen = []

    def spy(name, test):
        def reject(m):
            seen.append((name, len(m)))
            return test(m)

        return quality.Rule(name, ("n_words",), reject)

    column = pa.array(["a", "a b", "a b c", "a b c d"])
    rules = (spy("one", lambda m: m["n_words"] < 2), spy("two", lambda m: m["n_words"] < 4), spy("three", lambda m: m["n_words"] < 0))
    assert quality.verdicts(quality.Measures(column), rules).tolist() == [0, 1, 1, -1]
    assert seen == [("one", 4), ("two", 3), ("three", 1)]


def test_order_follows_rejections_per_cost_among_survivors(spark):
    docs = spark.createDataFrame([(k, "# " * 20 if k % 2 else "few" if k % 5 == 0 else " ".join(f"w{j}" for j in range(20))) for k in range(200)], "doc_id long, text string")
    names = [r.name for r in quality.order_rules(docs)]
    assert names.index("symbol_flood") < names.index("repeated_words") < names.index("repeated_lines") or names[0] == "few_words"
    assert names == [r.name for r in quality.order_rules(docs.repartition(7))]
    few = quality._sampled(docs, quality.RULES, "text", 40)
    assert 10 < sum(n for _, n, _ in few) < 100


def test_narrowed_measures_equal_fresh_ones():
    column = pa.array(texts())
    whole = quality.Measures(column)
    rows = np.arange(3, len(column), 4)
    whole["n_symbols"]
    part, fresh = whole.only(rows), quality.Measures(column.take(pa.array(rows)))
    for name in quality.EFFORT:
        assert (part[name] == fresh[name]).all() and (whole[name][rows] == fresh[name]).all()
