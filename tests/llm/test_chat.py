from __future__ import annotations

import random

from emberlog.llm import chat


def brute(rows):
    held = {}
    for c, turn, role, text in {r[:4] for r in rows if r[0] is not None}:
        held.setdefault(c, []).append((turn is not None, turn or 0, role is None, role or "", text is None, text or ""))
    seq = {c: tuple((m, r, b, t) for _, _, m, r, b, t in sorted(v)) for c, v in held.items()}
    out = []
    for c, s in seq.items():
        same = [x for x, v in seq.items() if v == s]
        if c == min(same) and not any(len(v) > len(s) and v[: len(s)] == s for v in seq.values()):
            out.append((c, len(s), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, _, t in s)))
    return sorted(out)


def test_equals_brute_force(spark):
    r = random.Random(5)
    said = ["hi", "", None, "what is é?", "x" * 5000, "ok"]
    rows, n = [], 0
    for _ in range(60):
        turns = [(k if k % 9 else k - 1, r.choice(["user", "assistant", None]), r.choice(said)) for k in range(r.randrange(1, 14))]
        for cut in sorted({r.randrange(1, len(turns) + 1) for _ in range(4)}):
            rows += [(n, *t, "web", n) for t in turns[:cut]]
            n += 1
    rows += [(None, 1, "user", "hi", "web", 1), (900, None, "user", "hi", "w", 1), (900, None, None, "hi", "w", 1), (901, 1 << 40, "user", "hi", "w", 1), (901, 3, "user", "late", "w", 1)]
    rows += [(950, k, "user", f"t{k}", "w", 1) for k in range(1500)] + [(951, k, "user", f"t{k}", "w", 1) for k in range(700)]
    rows += rows[10:30]
    r.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string, n long")
    assert sorted(map(tuple, chat.collapse(turns).collect())) == brute(rows)


def test_empty_table(spark):
    assert chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
