"""Personal data: fixed base patterns, plus a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (up to MOST_TOKENS tokens) of a region around digits
with features of the span and its left context, one weight vector per type; dynamic programming
chooses boundaries and types together. It is trained here by maximum likelihood on generated
sentences (a seeded rule, no corpus), in which negatives are versions, dates, prices,
plain numbers and numbers as long as a card's that fail its check digit. Base matches always stay; the field's spans are added where no base span lies.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.llm.common import frugal

# The base patterns, by kind as listed.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

#: Every match of the last three patterns lies in one such area, every e-mail in one run of its characters.
AREA = re.compile(r"[0-9+][\x20().0-9+-]{6,}")
RUN = re.compile(r"[A-Za-z0-9._%+@-]*")
RUN_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base spans, by kind as listed, then start."""
    found: list[Span] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in RUN_LEFT:
            lo -= 1
        hi = RUN.match(text, at).end()
        found += [(0, m.start() + lo, m.end() + lo) for m in EMAIL.finditer(text[lo:hi])]
        done = hi
        at = text.find("@", hi)
    for area in AREA.finditer(text):
        part, lo = area[0], area.start()
        if part.count(".") >= 3:
            found += [(1, lo + m.start(), lo + m.end()) for m in IP.finditer(part) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(part):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, lo + m.start(), lo + m.end()))
        if "+" in part:
            found += [(3, lo + m.start(), lo + m.end()) for m in PHONE.finditer(part) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


# The field.

MOST_TOKENS, MOST_CHARS = 12, 80
LEFT, RIGHT = 32, 48
TOKEN = re.compile(r"\w+|\s+|.", re.ASCII | re.DOTALL)
DIGITS = re.compile(r"[0-9]+")
LONG = re.compile(r"\w{16}", re.ASCII)
LONG_TOKEN = re.compile(r"\w{16,}", re.ASCII)
KEYWORDS = re.compile(r"(?i)(password|passwd|pwd|token|secret|api[_-]?key|key|bearer)\W*$")
NUMBERED = re.compile(r"(?i)(version|v\.?|no\.?|page|chapter|license|isbn|id|order)\W*$")
CALLED = re.compile(r"(?i)(call|tel|phone|mobile|fax|contact)\W*$")
FEATURES = (
    "bias", "email_form", "ip_form", "card_form", "phone_form", "national_form", "key_form", "hex_form", "mixed", "digits_0_6", "digits_7_9", "digits_10_12", "digits_13_19", "digits_20",
    "luhn", "plus", "parens", "dots", "has_space", "one_token", "long", "left_keyword", "left_numbered", "left_called", "left_joined", "right_joined", "date_form", "letters",
)
FORMS = {
    "email_form": re.compile(EMAIL.pattern),
    "ip_form": re.compile(r"(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}"),
    "card_form": re.compile(r"[0-9]{4}([ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}"),
    "phone_form": re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){2,3}"),
    "national_form": re.compile(r"(\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}"),
    "key_form": re.compile(r"[A-Z]{4}[0-9A-Z]{12,}"),
    "hex_form": re.compile(r"(?=[0-9]*[a-f])[0-9a-f]{16,}"),
    "date_form": re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}"),
}
INDEX = {f: i for i, f in enumerate(FEATURES)}


def span_features(text: str, lo: int, hi: int, tokens: int) -> list[int]:
    """Numbers of the features that a whole span has."""
    s = text[lo:hi]
    digits = "".join(DIGITS.findall(s))
    n, letters = len(digits), sum(c.isalpha() for c in s)
    left = text[max(0, lo - LEFT) : lo]
    on = ["bias", "digits_0_6" if n < 7 else "digits_7_9" if n < 10 else "digits_10_12" if n < 13 else "digits_13_19" if n < 20 else "digits_20"]
    on += [f for f, p in FORMS.items() if p.fullmatch(s)]
    flags = {
        "mixed": n >= 2 and letters >= 2 and tokens == 1, "luhn": 13 <= n <= 19 and not letters and luhn(digits), "plus": s[0] == "+", "parens": "(" in s,
        "dots": s.count(".") >= 3, "has_space": any(c.isspace() for c in s), "one_token": tokens == 1, "long": hi - lo >= 16, "letters": letters > 0,
        "left_keyword": bool(KEYWORDS.search(left)), "left_numbered": bool(NUMBERED.search(left)), "left_called": bool(CALLED.search(left)),
        "left_joined": lo > 0 and not text[lo - 1].isspace() and text[lo - 1] not in "=:\"'([<,;",
        "right_joined": hi < len(text) and (text[hi].isalnum() or (text[hi] in "-.@+/" and hi + 1 < len(text) and text[hi + 1].isalnum())),
    }
    return [INDEX[f] for f in (*on, *[f for f, v in flags.items() if v])]


def candidates(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """Candidate segments of a region, by first token: first token, end token, start, end, features.

    A candidate starts and ends on no white space and has four digits at least, or is one
    long token with a digit, or has an @ and a dot.
    """
    for i, (lo, _) in enumerate(tokens):
        if text[lo].isspace():
            continue
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            hi = tokens[j][1]
            if hi - lo > MOST_CHARS:
                break
            if text[hi - 1].isspace() or (text[hi - 1] in ",;" and j > i):
                continue
            s = text[lo:hi]
            if (n := sum(map(len, DIGITS.findall(s)))) >= 4 or (n and j == i and hi - lo >= 16) or ("@" in s and "." in s):
                yield i, j + 1, lo, hi, span_features(text, lo, hi, j + 1 - i)


def segments(text: str) -> tuple[int, list[tuple[int, int, int, int, list[int]]]]:
    """The number of tokens of a region and its candidate segments."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    return len(tokens), list(candidates(text, tokens))


def decode(text: str, weights: np.ndarray) -> list[Span]:
    """The best segmentation of a region; ties keep fewer and earlier spans."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    n = len(tokens)
    by_end: dict[int, list] = {}
    # One by one: a region may be a whole long text.
    for i, j, lo, hi, on in candidates(text, tokens):
        scores = weights[:, on].sum(axis=1)
        k = int(scores.argmax())
        if scores[k] > 0:
            by_end.setdefault(j, []).append((i, float(scores[k]), (k, lo, hi)))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, s, span in by_end.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, span)
    spans, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            j, span = back[j]
            spans.append(span)
    return spans[::-1]


def generated(seed: int, n: int) -> list[tuple[str, list[Span]]]:
    """Seeded sentences with known spans: all kinds, several forms each, and look-alikes that are none."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a=2, b=9: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = number(r.choice((13, 15, 16, 16, 16)) - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        return grouped(d)

    def grouped(d: str) -> str:
        return d if r.random() < 0.6 or len(d) != 16 else r.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    def no_card() -> str:
        d = number(r.choice((13, 15, 16, 16, 16, 19)) - 1)
        return grouped(d + next(c for c in r.sample("0123456789", 10) if not luhn(d + c)))

    def email() -> str:
        return f"{word()}{r.choice(('', '.', '_'))}{r.choice((word(), number(2)))}@{word()}{r.choice(('', number(1)))}.{r.choice(('example', word()))}.{r.choice(('com', 'org', 'net'))}"

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"))

    def secret() -> str:
        hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((18, 32, 40))))
        key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        return key if r.random() < 0.5 else hexes

    makers = {0: email, 1: lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), 2: card, 3: phone, 4: secret}
    nothing = (
        lambda: f"Version {r.randint(1, 9)}.{r.randint(0, 9)}.{number(4)}", lambda: f"20{number(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"${number(2)},{number(3)}.{number(2)}",
        lambda: number(r.randint(4, 12)), lambda: f"{number(4)} {number(4)}", lambda: f"19{number(2)}-19{number(2)}", lambda: f"page {number(4)}", lambda: f"{word()}{number(4)}", lambda: f"{word()}-{number(5)}",
        lambda: f"{number(1)}.{number(4)}", lambda: f"no. {number(6)}", lambda: f"{number(2)}.{number(2)}.{number(4)}", no_card, no_card,
    )
    out = []
    for _ in range(n):
        text, spans = word(), []
        for _ in range(r.randint(1, 3)):
            k = r.randint(-5, 4)
            if k < 0:
                text += f" {r.choice(nothing)()} {word()}"
                continue
            s = makers[k]()
            lead, quote = " ", ""
            if k == 4 and r.random() < 0.7:
                lead, quote = r.choice(((" password=", ""), (' token = "', '"'), (" secret: ", ""), (" api_key=", "")))
            elif k == 3 and r.random() < 0.3:
                lead = r.choice((" call ", " tel: ", " phone "))
            text += lead
            spans.append((k, len(text), len(text) + len(s)))
            text += s + quote + r.choice((" ", ", ", ". ")) + word()
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained(seed: int = 7, n: int = 500, epochs: int = 10, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights (kinds x features) by stochastic gradient of the log-likelihood; forward-backward over segments."""
    w = np.zeros((len(KINDS), len(FEATURES)))
    data = []
    for text, gold in generated(seed, n):
        size, found = segments(text)
        x = np.zeros((len(found), len(FEATURES)))
        y = np.full(len(found), -1)
        true = {(a, b): k for k, a, b in gold}
        for r, (_, _, lo, hi, on) in enumerate(found):
            x[r, on] = 1
            y[r] = true.get((lo, hi), -1)
        if len(found):
            data.append((size, [f[0] for f in found], [f[1] for f in found], x, y))
    order = random.Random(seed)
    for epoch in range(epochs):
        order.shuffle(data)
        step = rate / (1 + epoch)
        for size, firsts, ends, x, y in data:
            scores = np.clip(x @ w.T, -30, 30)
            total = np.logaddexp.reduce(scores, axis=1).tolist()
            fwd, bwd = [0.0] + [-math.inf] * size, [-math.inf] * size + [0.0]
            starts: dict[int, list[int]] = {}
            stops: dict[int, list[int]] = {}
            for r, (i, j) in enumerate(zip(firsts, ends, strict=True)):
                starts.setdefault(i, []).append(r)
                stops.setdefault(j, []).append(r)

            def plus(a: float, b: float) -> float:
                hi = a if a > b else b
                return hi + math.log1p(math.exp(-abs(a - b))) if hi > -math.inf and a > -math.inf and b > -math.inf else hi

            for j in range(1, size + 1):
                v = fwd[j - 1]
                for r in stops.get(j, ()):
                    v = plus(v, fwd[firsts[r]] + total[r])
                fwd[j] = v
            for i in range(size - 1, -1, -1):
                v = bwd[i + 1]
                for r in starts.get(i, ()):
                    v = plus(v, bwd[ends[r]] + total[r])
                bwd[i] = v
            chance = np.exp(np.minimum(0, np.array([fwd[i] + bwd[j] for i, j in zip(firsts, ends, strict=True)])[:, None] + scores - fwd[size]))
            real = np.zeros_like(chance)
            hit = np.flatnonzero(y >= 0)
            real[hit, y[hit]] = 1
            w += step * ((real - chance).T @ x - decay * w)
    return w


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Places around digits that may hold a span, joined when near: between two of them is no digit for LEFT + RIGHT characters, as many as a candidate has."""
    lo = hi = -1
    for m in DIGITS.finditer(text):
        a, b = max(0, m.start() - LEFT), min(len(text), m.end() + RIGHT)
        if a <= hi:
            hi = b
        else:
            if hi >= 0:
                yield lo, hi
            lo, hi = a, b
    if hi >= 0:
        yield lo, hi


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Spans of the field that touch no base span."""
    out = []
    for lo, hi in regions(text):
        # Whole words only: neither end cuts one.
        first, last = lo - 2048, hi + 2048
        while lo > 0 and not text[lo - 1].isspace() and text[lo - 1].isalnum() and lo > first:
            lo -= 1
        while hi < len(text) and text[hi].isalnum() and hi < last:
            hi += 1
        part = text[lo:hi]
        if sum(map(len, DIGITS.findall(part))) < 4 and not LONG.search(part):
            continue
        # Nothing is left for the field where base spans hold every digit and every long token.
        if all(any(a <= lo + m.start() and lo + m.end() <= b for _, a, b in base) for p in (DIGITS, LONG_TOKEN) for m in p.finditer(part)):
            continue
        for k, a, b in decode(part, weights):
            if not any(a + lo < y and x < b + lo for _, x, y in base):
                out.append((k, a + lo, b + lo))
    return sorted(set(out))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text.

    Columns: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added). A null
    text counts as empty and has no spans; repeated rows are each searched; other columns are not read.
    """
    weights = trained()
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                counts = [0] * 4
                for k, _, _ in base:
                    counts[k] += 1
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *added_spans(text, base, weights)])))
            columns = [batch.column(0), *(list(c) for c in zip(*rows, strict=True))] if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(search), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in spans):
        b = -b
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(text: Column) -> Column:
    """The text without personal data; null stays null."""
    weights = trained()

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            base = base_spans(t)
            return mask(t, [*base, *added_spans(t, base, weights)])

        return texts.map(one)

    return redact(text)
