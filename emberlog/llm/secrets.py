"""Secret scan: fixed patterns, and a battery of randomness tests for all other long tokens.

A candidate is a run of 20 or more token characters whose encoding can be told: hex,
base32, base36 or base64.  Over the alphabet of its encoding it is held against
  * the uniform alphabet (chi-squared),
  * the number of runs above and below the middle of the alphabet, and
  * the correlation of neighbours,
and it is taken as random only if none of them rejects.  Whether it is a discovery is then a
matter of its coincidences (equal pairs of characters): under text, equal pairs are TEXT
times as frequent as under the uniform alphabet, so few of them are evidence, and the more
so the longer the token.  These p-values are cut by Benjamini-Hochberg at level FDR over
the distinct tokens of the corpus, separately for each class of lengths.

Everything is built-in functions; only one cut-off per class of lengths comes to the driver.

Cases: a null or empty text has no span; repeated rows are scanned alike (a token
counts once for the cut-off); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.scratch import materialize

# Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

_CORE = "[A-Za-z0-9+/_-]"
#: 20 or more characters; "=" only where no other token character follows.
TOKEN = rf"(?=[A-Za-z0-9+/_=-]{{20}})(?:{_CORE}{{20,}}+(?:=++(?!{_CORE}))?|{_CORE}++=++(?!{_CORE}))"
#: How much more frequent equal pairs are in text than under a uniform alphabet.
TEXT = 1.7
#: A test of the battery rejects randomness below this p-value.
REJECT = 0.001
FDR = 0.05
#: Lower ends of the classes of lengths, each with its own cut-off.
LENGTHS = (20, 32, 48, 80)
BINS = 3000

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by precedence: name, what a token must look like, alphabet.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", _DIGIT + "abcdef"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", _UPPER + "234567"),
    ("base36", r"^(?=.*[0-9].*[0-9])(?=.*[a-z])[a-z0-9]+$", _DIGIT + _LOWER),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+=*$", _UPPER + _LOWER + _DIGIT + "+/"),
)


def located(text: Column, pattern: str) -> Column:
    """Matches with their places: array of struct(at, s), at in code points.

    Places are running sums of lengths.  As appending to an array copies it, the sums run in blocks of the square root
    of the matches, and then over the blocks.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kind = "array<struct<at:int,s:string>>"
    pairs = F.arrays_zip(found.alias("s"), F.transform(F.slice(between, 1, F.size(found)), F.length).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["to"] + x["gap"]
        return F.struct((at + F.length(x["s"])).alias("to"), F.array_append(acc["out"], F.struct(at.alias("at"), x["s"].alias("s"))).alias("out"))

    def within(held: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(held))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(held) - 1, size), lambda i: F.slice(held, i + 1, size))
        return F.transform(blocks, lambda b: F.aggregate(b, F.struct(F.lit(0).alias("to"), F.array().cast(kind).alias("out")), step))

    def across(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(blocks, begin, lambda acc, b: F.struct((acc["to"] + b["to"]).alias("to"), F.array_append(acc["out"], acc["to"]).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(b["out"], lambda x: F.struct((x["at"] + base).alias("at"), x["s"].alias("s")))))

    # each step binds its input once: a one-element array, transformed
    return F.when(text.rlike(pattern), F.transform(F.transform(F.array(pairs), within), across)[0]).otherwise(F.array().cast(kind))


def normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic form that is good to 0.0002."""
    return 1 / (1 + F.exp(F.lit(0.07056) * z * z * z + F.lit(1.5976) * z))


def _tested(s: Column) -> Column:
    """struct(size, bin): the class of lengths and -100 log10 p of a random-looking token, else null."""
    encoding = F.coalesce(*(F.when(s.rlike(p), F.lit(k)) for k, (_, p, _) in enumerate(ENCODINGS)))
    body = F.when(encoding == 0, F.lower(s)).when(encoding == 3, F.translate(s, "-_=", "+/")).otherwise(F.translate(s, "=", ""))
    alphabet = F.element_at(F.array(*(F.lit(a) for _, _, a in ENCODINGS)), encoding + 1)
    index = F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c).cast("double"))
    made = F.struct(index.alias("v"), F.length(body).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"), F.length(s).alias("len"))

    def numbers(t: Column) -> Column:
        v, n, k = t["v"], t["n"], t["k"]
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda acc, x: acc + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), 2.0))
        mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n
        var = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        co = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - mean) * (p["b"] - mean))
        turns = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + ((p["a"] > k / 2) != (p["b"] > k / 2)).cast("double"))
        above = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x > k / 2).cast("double"))
        return F.struct(n.alias("n"), k.alias("k"), squares.alias("squares"), var.alias("var"), co.alias("co"), turns.alias("turns"), above.alias("above"), t["len"].alias("len"))

    def judged(t: Column) -> Column:
        n, k = t["n"], t["k"]
        chi = k / n * t["squares"] - n
        df = k - 1
        z_chi = (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        both = 2 * t["above"] * (n - t["above"])
        expected, spread = both / n + 1, both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, F.abs(t["turns"] + 1 - expected) / F.sqrt(spread)).otherwise(F.lit(9.0))
        z_serial = F.when(t["var"] > 0, F.abs(t["co"] / t["var"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        random = (normal_tail(z_chi) >= REJECT) & (2 * normal_tail(z_runs) >= REJECT) & (2 * normal_tail(z_serial) >= REJECT)
        places = n * (n - 1) / 2
        rate = F.lit(TEXT) / k
        z = (places * rate - (t["squares"] - n) / 2) / F.sqrt(places * rate * (1 - rate))
        size = sum((t["len"] >= low).cast("int") for low in LENGTHS) - 1
        strength = F.least(F.lit(BINS), F.floor(-100 * F.log10(F.greatest(normal_tail(z), F.lit(1e-30))))).cast("int")
        return F.when(random, F.struct(size.alias("size"), strength.alias("bin")))

    return F.when(encoding.isNotNull(), F.transform(F.transform(F.array(made), numbers), judged)[0])


def found(docs: DataFrame) -> DataFrame:
    """Per document doc_id, the base matches (at, s) by kind, and its random-looking tokens
    (at, to, size, bin, token: a hash)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select("doc_id", text.alias("text")).withColumn("long", F.col("text").rlike(TOKEN))
    none = F.array().cast("array<struct<at:int,s:string>>")
    if_long = lambda p: F.when(F.col("long"), located(F.col("text"), p)).otherwise(none)
    base = held.select("doc_id", located(F.col("text"), ASSIGN).alias("assign"), if_long(ACCESS).alias("access"), if_long(HEX).alias("hex"), if_long(TOKEN).alias("tokens"))
    strong = F.filter("assign", lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= 6)
    tested = F.transform("tokens", lambda x: F.struct(x["at"].alias("at"), (x["at"] + F.length(x["s"])).alias("to"), F.xxhash64(x["s"]).alias("token"), _tested(x["s"]).alias("t")))
    return base.select("doc_id", strong.alias("assign"), "access", "hex", F.filter(tested, lambda x: x["t"].isNotNull()).alias("tokens"))


def cutoffs(tokens: DataFrame, level: float = FDR) -> list[int]:
    """Benjamini-Hochberg per class of lengths over distinct tokens (token, size, bin): the smallest
    bin that is a discovery.  At most BINS + 1 counts a class are ranked, however many tokens there are."""
    from pyspark.sql import Window

    counts = tokens.distinct().groupBy("size", "bin").agg(F.count("*").alias("n"))
    ranked = counts.select("size", "bin", F.sum("n").over(Window.partitionBy("size").orderBy(F.desc("bin"))).alias("rank"), F.sum("n").over(Window.partitionBy("size")).alias("m"))
    cut = {r["size"]: r["cut"] for r in ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 100) <= level * F.col("rank") / F.col("m")).groupBy("size").agg(F.min("bin").alias("cut")).collect()}
    return [cut.get(k, BINS + 1) for k in range(len(LENGTHS))]


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["at"].alias("at"), F.lit(kind).alias("kind"), (x["at"] + F.length(x["s"])).alias("to")))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["at"].cast("string"), x["to"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base spans and all spans as arrays of
    struct(at, kind, to), kind as a place in KINDS."""
    held = materialize(found(docs), "secrets")
    cuts = cutoffs(held.select(F.explode("tokens").alias("x")).select("x.token", "x.t.size", "x.t.bin"))
    base = F.concat(*(_spans(F.col(k), i) for i, k in enumerate(KINDS[:3])))
    cut = F.array(*map(F.lit, cuts))
    more = F.transform(F.filter("tokens", lambda x: x["t"]["bin"] >= F.element_at(cut, x["t"]["size"] + 1)), lambda x: F.struct(x["at"].alias("at"), F.lit(3).alias("kind"), x["to"].alias("to")))
    return held.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), base.alias("base"), F.concat(base, more).alias("every"))


def digest(docs: DataFrame) -> DataFrame:
    """The scan in contract form: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return scan(docs).select("doc_id", *(f"n_{k}" for k in KINDS[:3]), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))
