from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.llm import secrets

FORMS = ("{}", "AWS_SECRET_ACCESS_KEY={}", "export auth={} # now", "https://a.example/get?id=7&sig={}&x=1", "é key=={},", "a=b={}")


def test_values_glued_to_a_key_are_tested_like_the_value_alone(spark):
    r = random.Random(17)
    alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    values = ["".join(r.choice(alphabets[k % 3]) for _ in range(r.randrange(36, 60))) + "=" * (k % 3 == 0) * r.randrange(3) for k in range(60)]
    rows = [(k * len(FORMS) + j, form.format(v)) for k, v in enumerate(values) for j, form in enumerate(FORMS)]
    rows += [(1000, "plain words, no tokens"), (1001, None), (1002, "a=b=c=d=e=f=g=h=i=j=k=l=m=n"), (1003, "some_long_key_without_value=short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = {x.doc_id: x.tokens for x in secrets.found(df).collect()}
    spans = {x.doc_id: x.spans.split(",") for x in secrets.digest(df).collect()}
    tested = discovered = 0
    for k, v in enumerate(values):
        alone = tokens[k * len(FORMS)]
        for j, form in enumerate(FORMS):
            d, at = k * len(FORMS) + j, form.index("{")
            assert [(x.at, x.to, x.token, x.t) for x in tokens[d]] == [(at, at + len(v), x.token, x.t) for x in alone], form
            assert (f"random:{at}:{at + len(v)}" in spans[d]) == (f"random:0:{len(v)}" in spans[k * len(FORMS)])
        tested += len(alone)
        discovered += f"random:0:{len(v)}" in spans[k * len(FORMS)]
    assert tested > 50 and discovered > 40
    assert not any(tokens[d] for d in (1000, 1001, 1002, 1003))


BASE = (
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def brute_base(text):
    return sorted((m.start(), k, m.end()) for k, (p, fits) in enumerate(BASE) for m in p.finditer(text or "") if fits(m))


def tail(z):
    return 1 / (1 + math.exp(min(700.0, 0.07056 * z**3 + 1.5976 * z)))


def brute_token(s):
    """(class of lengths, bin) of a token that passes the battery, else None."""
    for name, pattern, alphabet in secrets.ENCODINGS:
        if re.search(pattern, s):
            break
    else:
        return None
    body = s.lower() if name == "hex" else s.replace("-", "+").replace("_", "/").replace("=", "") if name == "base64" else s.replace("=", "")
    v, n, k = [alphabet.index(c) + 1 for c in body], len(body), len(alphabet)
    squares = sum(c * c for c in Counter(v).values())
    chi, df = k / n * squares - n, k - 1
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    above, turns = sum(x > k / 2 for x in v), sum((a > k / 2) != (b > k / 2) for a, b in zip(v, v[1:]))
    both = 2 * above * (n - above)
    spread = both * (both - n) / (n * n * (n - 1))
    z_runs = abs(turns + 1 - both / n - 1) / math.sqrt(spread) if spread > 0 else 9.0
    mean = sum(v) / n
    var = sum((x - mean) ** 2 for x in v)
    z_serial = abs(sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / var + 1 / n) * math.sqrt(n) if var else 9.0
    if tail(z_chi) < secrets.REJECT or 2 * tail(z_runs) < secrets.REJECT or 2 * tail(z_serial) < secrets.REJECT:
        return None
    places, rate = n * (n - 1) / 2, secrets.TEXT / k
    z = (places * rate - (squares - n) / 2) / math.sqrt(places * rate * (1 - rate))
    return sum(len(s) >= low for low in secrets.LENGTHS) - 1, min(secrets.BINS, math.floor(-100 * math.log10(max(tail(z), 1e-30))))


def texts():
    r = random.Random(23)
    keys = ["password", "PassWd", "secret", "TOKEN", "api_key", "ApiKey", "word"]
    bits = ["é", " ", " ", "\n", "=", ":", "'", '"', "😀", "a", "F", "7", "AKIA" + "Q7" * 8, "AKIA1", "deadbeef" * 3, "0123456789abcdef0", "x.y-z_/+="]
    runs = lambda a, n: "".join(r.choice(a) for _ in range(n))
    out = [None, "", " ", "password", "password=", "secret: abc", "secret = 'abcdef'", "token==abcdef", "api_key:api_key:zzzzzz"]
    for _ in range(250):
        parts = [r.choice(bits) for _ in range(r.randrange(12))]
        parts += [f"{r.choice(keys)}{r.choice(['', chr(34)])}{r.choice([':', '=', ' = '])}{runs('abcXYZ019._-', r.randrange(12))}" for _ in range(r.randrange(3))]
        parts += [runs(r.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789", "aab1"]), r.randrange(18, 70)) for _ in range(r.randrange(3))]
        r.shuffle(parts)
        out.append(r.choice(["", " "]).join(parts))
    return out + out[20:30]


def test_spans_battery_and_cutoffs_equal_brute_force(spark):
    rows = [(k if k % 11 else None, t, k, "n") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_assign long, base string")
    token = re.compile(secrets.TOKEN)
    tested = [[(m.start(), m.end(), m[0], x) for m in token.finditer(t or "") if (x := brute_token(m[0])) is not None] for _, t, *_ in rows]
    distinct = {s: x for doc in tested for _, _, s, x in doc}
    cuts = []
    for size in range(len(secrets.LENGTHS)):
        bins = sorted((b for z, b in distinct.values() if z == size), reverse=True)
        cuts.append(min((b for b in bins if 10 ** (-b / 100) <= secrets.FDR * sum(x >= b for x in bins) / len(bins)), default=secrets.BINS + 1))
    want = []
    for (d, t, *_), found in zip(rows, tested):
        base = brute_base(t)
        every = sorted([*base, *((a, 3, b) for a, b, _, (size, strength) in found if strength >= cuts[size])])
        named = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((-1 if d is None else d, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(named(base).encode()).hexdigest(), named(every)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.digest(docs).collect())
    assert got == sorted(want)
    assert len(distinct) > 100 and any("random" in w[-1] for w in want) and any(c <= secrets.BINS for c in cuts)


def test_empty_table(spark):
    assert secrets.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_matches_in_one_text(spark):
    text = "".join(f"é secret=abcdef{k:06d} " for k in range(30_000))
    began = time.perf_counter()
    row = secrets.digest(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()[0]
    assert row.n_assign == 30_000 and time.perf_counter() - began < 60
    base = brute_base(text)
    assert row.base_sha256 == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, _, b in base).encode()).hexdigest()


@pytest.mark.parametrize("z", [-3.0, -1.0, 0.0, 0.5, 1.64, 3.09])
def test_normal_tail(spark, z):
    assert spark.range(1).select(secrets.normal_tail(F.lit(z))).first()[0] == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=2e-4)
