"""Personal data: fixed patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IPv4 addresses, card and phone
numbers.  The field adds what they miss: a text's tokens around each trigger
(digits, ``@``, a written-out "at") are segmented by dynamic programming over
whole candidate spans of at most ``LONGEST`` tokens; features describe a whole
span (digit count, grouping, checksum, separators, shape, the word before it),
so boundaries and types are chosen jointly.  Base spans stay; a span of the
field is added where it overlaps none.

The field is trained here, by its exact likelihood gradient, on a fixed number
of generated sentences with known spans.  One narrow pass over the texts; the
weights travel in the task's closure.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ["email", "ip", "card", "phone"]
LONGEST = 24  # tokens of a span: a written-out address of many parts
SENTENCES, EPOCHS, SEED = 240, 12, 7  # the training set and the steps

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
_TRIGGER = re.compile(r"[0-9]{2,}|@|[\[(]\s?at\s?[\])]", re.I)
_SPELLED = re.compile(r"[\[(]\s?[aA][tT]")
_REACH = 90  # characters of context at each side of a trigger


_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The matches of the e-mail pattern, from its ``@`` outwards: the pattern
    itself would try every word of the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found["phone"].append(m.span())
    return found


# The field.

FEATURES = [
    "bias", "starts_digit", "starts_plus", "starts_bracket", "ends_digit", "ends_letter", "ends_mark", "has_at", "has_spelled_at", "dot_after_at", "space_inside",
    "digits_0", "digits_1_6", "digits_7_9", "digits_10_15", "digits_16", "digits_17_19", "digits_more", "luhn", "four_parts", "all_octets", "groups_of_4", "one_number", "letters_inside",
    "marks_kinds", "touches_word", "touches_digit", "touches_mark", "cue_phone", "cue_card", "cue_email", "cue_ip", "only_phone_marks", "leading_zero", "hex_like",
]
_CUES = {"cue_phone": {"tel", "phone", "fax", "mobile", "call"}, "cue_card": {"card", "visa", "account", "iban", "konto"}, "cue_email": {"mail", "email", "contact"}, "cue_ip": {"ip", "host", "server", "addr"}}


def _features(text: str, spans: list[tuple[int, int]], i: int, j: int) -> np.ndarray:
    """Features of the segment of tokens i .. j (inclusive)."""
    a, b = spans[i][0], spans[j][1]
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    tokens = [text[x:y] for x, y in spans[i : j + 1]]
    low = s.lower()
    numbers = [t for t in tokens if t[0] in _DIGITS]  # ASCII digits only: others, as in "²", are no numbers
    letters = any(t.isalpha() for t in tokens)
    at = low.find("@")
    spelled = re.search(r"[\[(]\s?at\s?[\])]", low) is not None
    before, after = text[a - 1 : a], text[b : b + 1]
    previous = text[spans[i - 1][0] : spans[i - 1][1]].lower() if i else ""
    earlier = text[spans[i - 2][0] : spans[i - 2][1]].lower() if i > 1 else ""
    f = {
        "bias": 1, "starts_digit": s[0] in _DIGITS, "starts_plus": s[0] == "+", "starts_bracket": s[0] == "(", "ends_digit": s[-1] in _DIGITS, "ends_letter": s[-1].isalpha(), "ends_mark": not s[-1].isalnum(),
        "has_at": at >= 0, "has_spelled_at": spelled, "dot_after_at": (at >= 0 and "." in s[at:]) or (spelled and re.search(r"\.|[\[(]\s?dot\s?[\])]", low) is not None), "space_inside": any(c.isspace() for c in s),
        "digits_0": n == 0, "digits_1_6": 0 < n < 7, "digits_7_9": 7 <= n < 10, "digits_10_15": 10 <= n < 16, "digits_16": n == 16, "digits_17_19": 17 <= n < 20, "digits_more": n > 19, "luhn": 12 <= n < 20 and luhn(digits),
        "four_parts": len(numbers) == 4 and s.count(".") == 3, "all_octets": len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers), "groups_of_4": len(numbers) > 2 and all(len(x) == 4 for x in numbers),
        "one_number": len(tokens) == 1 and bool(numbers), "letters_inside": letters, "marks_kinds": min(len({t for t in tokens if not t.isalnum()}), 4) / 4, "touches_word": before.isalpha() or after.isalpha(),
        "touches_digit": before in _DIGITS or after in _DIGITS, "touches_mark": (before != "" and before in "_-@+.=/\"#") or (after != "" and after in "_-@=/\"#"),
        "only_phone_marks": set(s) <= set("+0123456789 ().-/"), "leading_zero": digits[:1] == "0", "hex_like": n > 0 and letters and re.fullmatch(r"[0-9a-f]+", low) is not None,
    }
    for cue, cues in _CUES.items():
        f[cue] = previous in cues or (not previous.isalnum() and earlier in cues)
    return np.array([float(f[k]) for k in FEATURES])


def _possible(text: str, spans: list[tuple[int, int]], i: int, j: int) -> bool:
    """Segments worth a score: no long gaps, and digits or an ``at`` inside."""
    if any(spans[k + 1][0] - spans[k][1] > 1 for k in range(i, j)) or "\n" in text[spans[i][0] : spans[j][1]]:
        return False
    first, last = text[spans[i][0]], text[spans[j][1] - 1]
    return (first.isalnum() or first in "+(") and last.isalnum() | (last in ")]") and _TRIGGER.search(text, spans[i][0], spans[j][1]) is not None


def _segments(text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, np.ndarray]]]:
    """For each end token: (first token, features) of the possible segments."""
    out = []
    for j in range(len(spans)):
        out.append([(i, _features(text, spans, i, j)) for i in range(max(0, j - LONGEST + 1), j + 1) if _possible(text, spans, i, j)])
    return out


def _forward(segments: list, w: np.ndarray) -> tuple[np.ndarray, list]:
    """Log sums of all segmentations up to each token, and segment scores."""
    a, scores = np.zeros(len(segments) + 1), []
    for j, own in enumerate(segments):
        scores.append([w @ f for _, f in own])
        a[j + 1] = np.logaddexp.reduce(np.concatenate([[a[j]], *(a[i] + s for (i, _), s in zip(own, scores[-1], strict=True))]))
    return a, scores


def _gradient(segments: list, gold: set, w: np.ndarray) -> np.ndarray:
    """Of the log likelihood of the gold spans (first, last, kind)."""
    a, scores = _forward(segments, w)
    n = len(segments)
    b = np.zeros(n + 1)
    starts: list[list] = [[] for _ in range(n)]
    for j, own in enumerate(segments):
        for (i, f), s in zip(own, scores[j], strict=True):
            starts[i].append((j, f, s))
    g = np.zeros_like(w)
    for i in reversed(range(n)):
        b[i] = np.logaddexp.reduce(np.concatenate([[b[i + 1]], *(s + b[j + 1] for j, _, s in starts[i])]))
        for j, f, s in starts[i]:
            g -= np.exp(a[i] + s + b[j + 1] - a[n])[:, None] * f
            for k in range(len(KINDS)):
                if (i, j, k) in gold:
                    g[k] += f
    return g


def _sentences(rng: random.Random) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with their spans: entities in several spellings, and
    numbers that are none (years, versions, prices, tokens, long ids)."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abdeghilmnorstuv", k=rng.randint(2, 9)))

    def card() -> str:
        d = rng.choice("3456") + digits(15) if rng.random() < 0.5 else digits(16)
        return rng.choice([d, d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} {a} {b} {c}"])

    def email() -> str:
        at, dot = rng.choice([("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", "."), ("[at]", " [dot] ")])
        return f"{word()}{rng.choice(['', '.' + digits(2), '_' + word()])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def other() -> str:
        return rng.choice([digits(rng.randint(1, 8)), f"{rng.randint(1900, 2100)}", f"{rng.randint(0, 9)}.{rng.randint(0, 99)}", f"{rng.randint(1, 99)},{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", digits(rng.randint(21, 30)), f'token = "{"".join(rng.choices("0123456789abcdef", k=40))}"', f"@{word()}", f"{digits(2)}:{digits(2)}", f"v{digits(2)}", f"{word()}{digits(3)}", f"page {digits(2)} of {digits(3)}"])

    makers = [email, ip, card, phone]
    out = []
    for _ in range(SENTENCES):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", " ", " ", ": ", ", "])
            k = rng.randrange(7)
            made = makers[k]() if k < 4 else other()
            if k < 4:
                spans.append((len(text), len(text) + len(made), k))
            text += made + rng.choice([" ", ". ", ", ", "!! "])
        out.append((text + word(), spans))
    return out


@functools.cache
def trained() -> np.ndarray:
    """Weights by kind and feature: gradient steps over the generated set."""
    rows = []
    for text, own in _sentences(random.Random(SEED)):
        spans = [m.span() for m in _TOKEN.finditer(text)]
        first, last = {a: i for i, (a, _) in enumerate(spans)}, {b: i for i, (_, b) in enumerate(spans)}
        rows.append((_segments(text, spans), {(first[a], last[b], k) for a, b, k in own if a in first and b in last}))
    w, size = np.zeros((len(KINDS), len(FEATURES))), np.full((len(KINDS), len(FEATURES)), 1e-8)
    for _ in range(EPOCHS):
        for start in range(0, len(rows), 24):
            g = sum((_gradient(s, gold, w) for s, gold in rows[start : start + 24]), np.zeros_like(w)) - 0.01 * w
            size += g * g
            w += 0.6 * g / np.sqrt(size)
    return w


def field_spans(text: str, w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) by the best segmentation around each trigger."""
    regions: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - _REACH), min(len(text), m.end() + _REACH)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        # Regions end at white space, so that no token is cut.
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        part = text[a:b]
        spans = [m.span() for m in _TOKEN.finditer(part)]
        best, back = [0.0], []
        for j in range(len(spans)):
            top, how = best[j], None
            for i in range(max(0, j - LONGEST + 1), j + 1):
                if _possible(part, spans, i, j):
                    s = w @ _features(part, spans, i, j)
                    k = int(np.argmax(s))
                    if best[i] + s[k] > top:
                        top, how = best[i] + float(s[k]), (i, k)
            best.append(top)
            back.append(how)
        j = len(spans) - 1
        while j >= 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((a + spans[i][0], a + spans[j][1], k))
                j = i - 1
    return sorted(out)


def find(text: str, w: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans, and of all spans."""
    if not (_DIGIT.search(text) or "@" in text or (("(" in text or "[" in text) and _SPELLED.search(text))):
        return [], []
    by = base_spans(text)
    base = sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in by[kind])
    if not _TRIGGER.search(text):
        return base, base
    added = []
    for a, b, k in field_spans(text, w):
        if all(b <= x or a >= y for x, _, y in base):
            added.append((a, k, b))
    return base, sorted([*base, *added])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (base), base_spans, spans and
    n_spans (all of ``spans``).

    Spans are ``kind:start:end`` in code points, by start, then by kind as
    listed.  Null and empty texts have none; repeated rows are read alike; a long
    text is read whole, in time that grows with its length; an empty table gives
    an empty one; columns of these names in ``docs`` are replaced.
    """
    schema = T.StructType.fromDDL(", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string, n_spans long")
    w = trained()

    def make():
        def run(values: list) -> dict:
            got: dict[str, list] = {f.name: [] for f in schema}
            for v in values:
                base, every = find(v or "", w)
                for k, kind in enumerate(KINDS):
                    got[f"n_{kind}"].append(sum(x[1] == k for x in base))
                got["base_spans"].append(_joined(base))
                got["spans"].append(_joined(every))
                got["n_spans"].append(len(every))
            return got

        return run

    return common.append(docs, schema, F.col(text_col).cast("string"), make)


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[{}]") -> DataFrame:
    """``docs`` with every span replaced by its kind in the text.

    A null text stays null; every other column, repeated rows and empty tables
    pass as they are, whatever the names of the columns.
    """
    found = with_spans(common.as_row(docs), common.nested(text_col))

    def make():
        def run(values: list) -> dict:
            out = []
            for v in values:
                text, last, parts = v["text"], 0, []
                for s in filter(None, (v["spans"] or "").split(",")):
                    kind, a, b = s.split(":")
                    if int(b) > last:
                        parts += [text[last : max(int(a), last)], mask.format(kind)]
                        last = int(b)
                out.append(text if text is None else "".join([*parts, text[last:]]))
            return {"__text": out}

        return run

    one = T.StructType([T.StructField("__text", T.StringType())])
    masked = common.append(found, one, F.struct(F.col(common.nested(text_col)).cast("string").alias("text"), "spans"), make)
    return masked.select(*[F.col("__text").alias(c) if c == text_col else F.col(common.nested(c)) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_spans(docs).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")
