"""Personal data: fixed patterns, and a linear-chain conditional random field for the rest.

The field labels words by their shapes (digits, letters, punctuation, a few cue words) and those of
two words to either side.  It is trained here, on a small labelled table that ``training_table``
writes from templates (SENTENCES of them: a fixed bound), by gradient ascent on the likelihood; the
best labels of whole texts come from Viterbi's recursion, many at a time in numpy.  It runs only where
a label other than O may pay: a bound over all spans that cover a word shows of most words that the
best path has O there (``Field.open_words``), and stretches between such words do not depend on each other.

Cases: a null or empty text has no span; repeated rows are scanned alike; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberlog.llm.textnum import Texts, slices

KINDS = ("email", "ip", "card", "phone")
MORE = ("local_phone", "id_number", "person")
LABELS = ("O", *(f"{p}-{k}" for k in MORE for p in "BI"))
SENTENCES = 1500
OFFSETS = (-2, -1, 0, 1, 2)
CUES = ("mr", "mrs", "ms", "dr", "name", "named", "contact", "phone", "tel", "telephone", "call", "mobile", "fax", "ssn", "passport", "id", "born", "signed", "dear", "social", "security", "number", "is", "at", "on", "my", "her", "his", "our", "reach", "dial", "ring", "cell", "text", "by", "from", "with", "told", "said", "asked", "wrote", "met", "prof", "sir", "sincerely", "regards", "of", "in", "the", "a")
#: Words of digits and marks whose exact shape counts (d: a digit); all others count by the rough shape.
EXACT = ("ddd-ddd-dddd", "ddd.ddd.dddd", "ddd/ddd-dddd", "(ddd)ddd-dddd", "(ddd)", "ddd-dddd", "ddd.dddd", "ddd-dd-dddd", "ddd", "dd", "d", "dddd", "dddddddddd", "ddddddddd", "dddd-dd-dd", "dd-dd-dddd", "dd/dd/dddd", "dd.dd.dddd", "dd:dd", "ddddd", "dddddd", "ddd,ddd", "ddd.dd", "dd.ddd.dd.ddd", "ddd.ddd.ddd.ddd")
SHAPES = 7 * 4 * 5 + len(EXACT)

# ---------------------------------------------------------------- base patterns (fixed values)

AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
ZONE = re.compile(r"[0-9][\x20().0-9-]{6,}")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, each kind leftmost and without overlaps.

    An address is found from its @: its local part is the run of allowed characters before it, back to
    the last match; numbers are looked for in runs of digits, spaces, dots, dashes and brackets,
    which no match leaves.
    """
    out = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = AT.match(text, at) if begin < at else None
        if m:
            out.append((begin, 0, m.end()))
            done = at = m.end()
        else:
            done, at = at + 1, at + 1
    for zone in ZONE.finditer(text):
        a, b = zone.span()
        for m in IP.finditer(text, a, b):
            if all(int(x) <= 255 for x in m[0].split(".") if len(x.lstrip("0")) < 4) and all(len(x.lstrip("0")) < 4 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text, a, b):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if a and text[a - 1] == "+":
            body = zone[0].rstrip(" ().-")
            if len(body) >= 3 and 9 <= sum(c.isdigit() for c in body) <= 15:
                out.append((a - 1, 3, a + len(body)))
    return sorted(out)


# ---------------------------------------------------------------- shapes

_CLASS = np.zeros(256, np.uint8)  # 1 digit, 2 upper, 3 lower or non-ASCII, 4 joiner, 5 bracket, 6 at sign, 0 other
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 3
for _c, _k in (("-./", 4), ("()+", 5), ("@", 6)):
    for _x in _c.encode():
        _CLASS[_x] = _k
_TRIM = (_CLASS == 0) | np.isin(np.arange(256), list(b"."))


def _cue_hashes() -> np.ndarray:
    t = Texts(pa.array(CUES))
    return t.hashes(t.offs[:-1], t.offs[1:], fold=True)


def shapes(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: shape code, and trimmed start and end (bytes)."""
    starts, ends, _ = texts.words()
    kinds = _CLASS[texts.data]

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums[ends] - sums[starts]

    digits, upper, lower = count(kinds == 1), count(kinds == 2), count(kinds == 3)
    joiners, brackets, ats = count(kinds == 4), count(kinds == 5), count(kinds == 6)
    trim = _TRIM[texts.data]
    body = ~trim
    place = np.arange(len(body))
    first = np.minimum.accumulate(np.where(body, place, len(body))[::-1])[::-1] if len(body) else place
    last = np.maximum.accumulate(np.where(body, place, -1)) if len(body) else place
    a, b = first[starts], last[ends - 1] + 1
    bare = a >= ends
    a, b = np.where(bare, starts, a), np.where(bare, ends, np.maximum(b, starts + 1))
    bucket = np.array([0, 1, 2, 3, 4, 5, 5, 5, 5], np.int32)[np.minimum(digits, 8)] + (digits > 8)
    head = kinds[np.minimum(a, max(len(kinds) - 1, 0))] if len(kinds) else a
    letters = np.where(upper + lower == 0, 0, np.where(upper == 0, 1, np.where((upper == 1) & (head == 2) & (lower > 0), 2, 3)))
    marks = np.where(ats > 0, 3, np.where(brackets > 0, 2, np.where((joiners > 0) & (b - a > 1) & (digits > 0), 1, np.where(b < ends, 4, 0))))
    code = (bucket * 4 + letters) * 5 + marks
    masked = Texts.__new__(Texts)
    masked.data, masked.offs, masked._sums, masked._words = np.where(kinds == 1, np.uint8(100), texts.data), texts.offs, {}, None
    exact = Texts(pa.array(EXACT))
    known = exact.hashes(exact.offs[:-1], exact.offs[1:])
    rank = np.argsort(known)
    some = np.flatnonzero((digits > 0) & (upper + lower == 0))
    found = masked.hashes(a[some], b[some])
    spot = np.minimum(np.searchsorted(known[rank], found), len(known) - 1)
    right = known[rank][spot] == found
    code[some[right]] = SHAPES - len(EXACT) + rank[spot[right]]
    hashes, cues = texts.hashes(a, b, fold=True), _cue_hashes()
    order = np.argsort(cues)
    at = np.minimum(np.searchsorted(cues[order], hashes), len(cues) - 1)
    cue = cues[order][at] == hashes
    code = np.where(cue, SHAPES + order[at], code)
    return code, a, b


# ---------------------------------------------------------------- the field


class Field:
    """Weights of a linear-chain field: emit[offset, code, label] and move[label, label]."""

    def __init__(self, codes: int):
        self.codes = codes + 1  # the last code stands for "no word"
        self.emit = np.zeros((len(OFFSETS), self.codes, len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))
        # an inside label only follows its own kind
        self.ban = np.zeros_like(self.move)
        for j, to in enumerate(LABELS):
            if to[0] == "I":
                self.ban[[i for i, was in enumerate(LABELS) if was[2:] != to[2:] or was == "O"], j] = -1e4

    def scores(self, code: np.ndarray) -> np.ndarray:
        """(n, t, labels) of padded codes (n, t)."""
        n, t = code.shape
        wide = np.full((n, t + 4), self.codes - 1, np.int64)
        wide[:, 2:-2] = code
        out = sum(self.emit[k, wide[:, 2 + o : 2 + o + t]] for k, o in enumerate(OFFSETS))
        out[:, 0, [j for j, x in enumerate(LABELS) if x[0] == "I"]] = -1e4
        return out

    def viterbi(self, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best labels (n, t) of padded texts."""
        return self.best(self.scores(code), sizes)

    def best(self, s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best labels (n, t) by scores (n, t, labels)."""
        move = self.move + self.ban
        n, t, k = s.shape
        back = np.zeros((n, t, k), np.int8)
        best = s[:, 0].copy()
        for i in range(1, t):
            step = best[:, :, None] + move
            back[:, i] = step.argmax(axis=1)
            new = step.max(axis=1) + s[:, i]
            best = np.where((i < sizes)[:, None], new, best)
        out = np.zeros((n, t), np.int8)
        label = best.argmax(axis=1)
        for i in range(t - 1, -1, -1):
            inside = i < sizes
            out[:, i] = np.where(inside, label, 0)
            if i:
                label = np.where(inside, back[np.arange(n), i, label], label)
        return out

    def open_words(self, wide: np.ndarray, spots: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Which words a best path may label with anything but O; opens and closes: the words that begin and end a text.

        If a best path had a span of some kind at words s to e, O in its place would not score more.  What the
        span gains over O is its words' gains, its own moves, and at most the best of the moves from and to any neighbours;
        the most that a span around a word can gain is the best of all starts up to it and all ends from it, by
        running maxima over running sums.  Below zero (less what rounding may add), the word is O.
        """
        found = np.zeros(len(spots), bool)
        after = [j for j, x in enumerate(LABELS) if x[0] != "I"]
        for b in range(1, len(LABELS), 2):
            i = b + 1
            head, inner = (sum((self.emit[k, :, j] - self.emit[k, :, 0])[wide[spots + o]] for k, o in enumerate(OFFSETS)) for j in (b, i))
            head += np.where(opens, 0, (self.move[:, b] - self.move[:, 0]).max())
            end_b, end_i = (np.where(closes, 0, (self.move[j, after] - self.move[0, after]).max()) for j in (b, i))
            inner += self.move[i, i] - self.move[0, 0]
            inner[opens] = -1e4  # no span crosses texts
            sums = np.cumsum(inner)
            start, stop = head + self.move[b, i] - self.move[i, i] - sums, sums + end_i
            most = np.maximum.accumulate(stop[::-1])[::-1]
            gain = head + end_b
            gain[:-1] = np.maximum(gain[:-1], start[:-1] + most[1:])
            gain[1:] = np.maximum(gain[1:], np.maximum.accumulate(start)[:-1] + most[1:])
            found |= gain >= -1e-9 - 4 * len(sums) * np.finfo(float).eps * np.abs(sums).max()
        return found

    def labels(self, code: np.ndarray, first: np.ndarray, cells: int = 1 << 18) -> np.ndarray:
        """The best label of each word of whole texts; first: per text the number of its first word (n + 1 values)."""
        out = np.zeros(len(code), np.int8)
        if not len(code):
            return out
        worded = np.diff(first) > 0
        opens, closes = np.zeros(len(code), bool), np.zeros(len(code), bool)
        opens[first[:-1][worded]] = closes[first[1:][worded] - 1] = True
        spots = np.arange(len(code)) + 2 * np.cumsum(opens)  # two places of no word before and behind each text
        wide = np.full(spots[-1] + 3, self.codes - 1, np.int64)
        wide[spots] = code
        some = self.open_words(wide, spots, opens, closes)
        begin, end = some.copy(), some.copy()
        begin[1:] &= ~some[:-1] | opens[1:]
        end[:-1] &= ~some[1:] | closes[:-1]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        sizes, move = end - begin, self.move + self.ban
        order = np.argsort(sizes, kind="stable")
        inside = [j for j, x in enumerate(LABELS) if x[0] == "I"]
        at = 0
        while at < len(order):
            # one batch: lengths up to twice the shortest, so that padding stays below half
            near = order[at : at + int(np.searchsorted(sizes[order[at:]], 2 * sizes[order[at]], side="right"))]
            to = at + max(1, int(np.searchsorted(sizes[near] * np.arange(1, len(near) + 1), cells)))
            pick = order[at:to]
            n, rows = sizes[pick], np.arange(to - at)
            cols = np.arange(int(n[-1]))
            place = np.minimum(spots[begin[pick]][:, None] + cols, len(wide) - 3)
            s = sum(self.emit[k, wide[place + o]] for k, o in enumerate(OFFSETS))
            s[np.ix_(opens[begin[pick]], [0], inside)] = -1e4
            # the words around a stretch are O
            s[:, 0] += np.where(opens[begin[pick]][:, None], 0, move[0])
            s[rows, n - 1] += np.where(closes[end[pick] - 1][:, None], 0, move[:, 0])
            mine = cols < n[:, None]
            out[(begin[pick][:, None] + cols)[mine]] = self.best(s, n)[mine]
            at = to
        return out

    def gradient(self, code: np.ndarray, sizes: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the labels and its gradient, by the forward-backward recursion."""
        s, move = self.scores(code), self.move + self.ban
        n, t, k = s.shape
        mask = np.arange(t) < sizes[:, None]
        pass_on = np.exp(move)

        def sent(x: np.ndarray, by: np.ndarray) -> np.ndarray:
            """log of exp(x) @ by, row by row; what has no way in gets a very small number."""
            high = x.max(axis=1, keepdims=True)
            return np.log(np.exp(x - high) @ by + 1e-300) + high

        fore, aft = np.zeros((n, t, k)), np.zeros((n, t, k))
        fore[:, 0] = s[:, 0]
        for i in range(1, t):
            fore[:, i] = np.where(mask[:, i, None], sent(fore[:, i - 1], pass_on) + s[:, i], fore[:, i - 1])
        for i in range(t - 2, -1, -1):
            aft[:, i] = np.where(mask[:, i + 1, None], sent(s[:, i + 1] + aft[:, i + 1], pass_on.T), 0)
        high = fore[:, -1].max(axis=1)
        total = np.log(np.exp(fore[:, -1] - high[:, None]).sum(axis=1)) + high
        unary = np.exp(fore + aft - total[:, None, None]) * mask[:, :, None]
        hot = np.eye(k)[gold] * mask[:, :, None]
        wide = np.full((n, t + 4), self.codes - 1, np.int64)
        wide[:, 2:-2] = code
        g_emit, g_move = np.zeros_like(self.emit), np.zeros_like(self.move)
        rest = (hot - unary)[mask]
        for j, o in enumerate(OFFSETS):
            at = wide[:, 2 + o : 2 + o + t][mask]
            for label in range(k):
                g_emit[j, :, label] += np.bincount(at, rest[:, label], self.codes)
        value = (s * hot).sum()
        for i in range(1, t):
            was, now = fore[:, i - 1], s[:, i] + aft[:, i]
            m, w = was.max(axis=1), now.max(axis=1)
            weight = np.exp(m + w - total) * mask[:, i]
            pair = pass_on * ((np.exp(was - m[:, None]) * weight[:, None]).T @ np.exp(now - w[:, None]))
            seen = hot[:, i - 1].T @ hot[:, i]
            value += (seen * move).sum()
            g_move += seen - pair
        return float(value - total.sum()), g_emit, g_move


def training_table(seed: int = 1, n: int = SENTENCES) -> list[list[tuple[str, str]]]:
    """Labelled sentences: (word, label) lists."""
    r = random.Random(seed)
    syllables = ("an", "er", "lo", "mi", "ta", "ken", "sol", "vi", "dra", "pe", "un", "ish", "the", "of")
    small = ("is", "at", "on", "my", "her", "his", "our", "by", "from", "with", "of", "in", "the", "a", "said", "asked", "wrote", "met")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: word().capitalize()
    tail = lambda w: w + r.choice(("", "", ",", ".", "?", "!", ";"))
    cased = lambda w: r.choice((w, w, w.capitalize()))

    def phone() -> list[str]:
        return r.choice(([f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}.{digits(4)}"], [f"({digits(3)}){digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"{digits(3)}.{digits(3)}.{digits(4)}"], [f"{digits(3)}/{digits(3)}-{digits(4)}"], [digits(3), digits(3), digits(4)], [digits(3), f"{digits(3)}-{digits(4)}"]))

    def idno() -> list[str]:
        return r.choice(([f"{digits(3)}-{digits(2)}-{digits(4)}"], [f"{digits(3)}-{digits(2)}-{digits(4)}"], [digits(3), digits(2), digits(4)]))

    def spread(kind: str, words: list[str]) -> list[tuple[str, str]]:
        return [(w if k < len(words) - 1 else tail(w), f"{'B' if k == 0 else 'I'}-{kind}") for k, w in enumerate(words)]

    def number() -> str:
        return r.choice((digits(r.randrange(1, 6)), f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}-{digits(2)}-{digits(4)}", f"${digits(3)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(2)}:{digits(2)}", digits(r.randrange(8, 20)), f"{digits(3)},{digits(3)}", word() + digits(2), f"{word()}.{digits(2)}@{word()}.com", f"{digits(2)}.{digits(3)}.{digits(2)}.{digits(3)}", f"{digits(3)}.{digits(2)}", digits(10), digits(9)))

    def filler(k: int) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for _ in range(k):
            x = r.random()
            # capitalised words stand alone at sentence starts and as names of places
            w = name() if x < 0.1 and not (out and out[-1][0][:1].isupper()) else r.choice(small) if x < 0.35 else word() if x < 0.85 else number()
            out.append((tail(w) if r.random() < 0.4 else w, "O"))
        return out

    table = []
    for _ in range(n):
        x = r.random()
        if x < 0.22:
            lead = r.choice((["phone:"], ["tel"], ["call"], ["call", "me", "at"], ["mobile"], ["cell"], ["fax:"], ["my", "phone", "is"], ["our", "number", "is"], ["reach", word(), "at"], ["dial"], ["ring"], ["text"], ["telephone", "number"], [], []))
            middle = [(cased(w), "O") for w in lead] + spread("local_phone", phone())
        elif x < 0.42:
            lead = r.choice((["SSN"], ["social", "security", "number"], ["social", "security", "number", "is"], ["passport"], ["id:"], ["ssn:"], ["her", "ssn", "is"], ["his", "id", "number", "is"], ["ssn", "of", word(), "is"], ["id", "number"]))
            middle = [(cased(w), "O") for w in lead] + spread("id_number", idno())
        elif x < 0.56:
            cue = r.choice(("Mr", "Mrs.", "Dr.", "Prof.", "Sir", "mr.", "name:", "named", "contact", "Ms", "dear", "signed", "Sincerely,", "Regards,"))
            middle = [(cue, "O")] + spread("person", [name() for _ in range(r.randrange(1, 3) if cue != "contact" else 2)])
            middle += [(word(), "O")]
        elif x < 0.68:
            # no cue but the words around: two or three capitalised words in running prose
            cue = r.choice(("by", "from", "with", "told", "asked", "met", "said", word()))
            middle = [(word(), "O"), (cue, "O")] + spread("person", [name() for _ in range(r.randrange(2, 4))]) + [(r.choice(("said", "wrote", "asked", "told", word(), word())), "O")]
        else:
            lead = r.choice((["name"], ["the", "name"], ["call"], ["contact"], ["number"], ["id"], ["born"], ["the", "number", "is"], ["call", "at"], [word()]))
            if r.random() < 0.25:  # names of things stand behind an article
                lead = [r.choice(("the", "a", "this")), *(name() for _ in range(r.randrange(1, 4)))]
            middle = [(w, "O") for w in lead] + [(tail(name()), "O")] * (r.random() < 0.3) + [(tail(number()), "O")] * (r.random() < 0.5) + [(word(), "O")]
        table.append(filler(r.randrange(0, 6)) + middle + filler(r.randrange(0, 6)))
    return table


def _padded(table: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = Texts(pa.array([" ".join(w for w, _ in row) for row in table]))
    code, _, _ = shapes(texts)
    first = texts.words()[2]
    sizes = np.diff(first)
    codes = np.full((len(table), sizes.max()), SHAPES + len(CUES), np.int64)
    gold = np.zeros_like(codes)
    for k, row in enumerate(table):
        codes[k, : sizes[k]] = code[first[k] : first[k + 1]]
        gold[k, : sizes[k]] = [LABELS.index(x) for _, x in row]
    return codes, sizes, gold


@functools.lru_cache(maxsize=2)
def trained(seed: int = 1, steps: int = 120, shrink: float = 1e-3) -> Field:
    """The field after steps of Adam on the training table."""
    codes, sizes, gold = _padded(training_table(seed))
    field = Field(SHAPES + len(CUES))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (field.emit, field.move)]
    for step in range(1, steps + 1):
        _, *grads = field.gradient(codes, sizes, gold)
        for w, g, (m, v) in zip((field.emit, field.move), grads, moments):
            g = g / len(codes) - shrink * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


def _valid(kind: str, words: list[bytes]) -> bool:
    digits = sum(48 <= c < 58 for w in words for c in w)
    if kind == "local_phone":
        return digits == 10
    if kind == "id_number":
        return digits == 9
    return len(set(words)) == len(words) <= 4 and all(w[:1].isupper() or w[:1] >= b"\x80" for w in words) and not digits


def field_spans(texts: Texts, field: Field) -> list[list[tuple[int, int, int]]]:
    """Per text (start, kind, end) of the spans that the field finds, in code points."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    code, a, b = shapes(texts)
    first = texts.words()[2]
    labels = field.labels(code, first)
    begin = np.flatnonzero(labels % 2)
    if not len(begin):
        return out
    letters = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=letters[1:])
    for j, doc in zip(begin.tolist(), (np.searchsorted(first, begin, side="right") - 1).tolist()):
        stop = j + 1
        while stop < first[doc + 1] and labels[stop] == labels[j] + 1:
            stop += 1
        kind = LABELS[labels[j]][2:]
        if _valid(kind, [texts.data[a[w] : b[w]].tobytes() for w in range(j, stop)]):
            zero = letters[texts.offs[doc]]
            out[doc].append((int(letters[a[j]] - zero), len(KINDS) + MORE.index(kind), int(letters[b[stop - 1]] - zero)))
    return out


# ---------------------------------------------------------------- operators


def named(spans: list[tuple[int, int, int]]) -> str:
    every = (*KINDS, *MORE)
    return ",".join(f"{every[k]}:{a}:{b}" for a, k, b in spans)


def _apart(extra: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of extra that share no place with one of base, which comes sorted."""
    if not extra or not base:
        return extra
    starts = np.array([x[0] for x in base])
    reach = np.maximum.accumulate([x[2] for x in base])
    before = np.searchsorted(starts, [x[2] for x in extra])  # base spans that begin before each one's end
    return [x for x, k in zip(extra, before.tolist()) if not k or reach[k - 1] <= x[0]]


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined).

    Spans of the field that touch one of a fixed pattern are left out; the fixed ones always stay.
    """
    field = trained()
    sent = docs.sparkSession.sparkContext.broadcast((field.emit, field.move))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(SHAPES + len(CUES))
        own.emit, own.move = sent.value
        for batch in slices(batches, size=1 << 20):
            column = batch.column(1)
            more = field_spans(Texts(column), own)
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, every = [], []
            for text, extra in zip(column.to_pylist(), more):
                base = base_spans(text or "")
                for k in range(len(KINDS)):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(named(base).encode()).hexdigest())
                new = _apart(extra, base)
                every.append(named(sorted([*base, *new])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
