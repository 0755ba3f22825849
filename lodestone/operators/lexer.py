"""Symbols, their extents and calls in languages with braces, by a lexer and depths.

One alternation reads comments, strings and characters, longest construct first, as an
automaton would; what they hold is blanked, line feeds stay.  Braces and brackets of what
is left, summed from the start, give the depth at each place: a body ends where the
depth comes back to what it was before its opening brace.  One narrow pass; a file's
time grows with its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)'
_CHAR = r"'(?:\\(?:[^\n'][^\n']*|.)|[^'\\\n])'"
_SINGLE = r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_TEMPLATE = r"`(?:\\.|[^`\\])*(?:`|\Z)"
_REGEX = r"(?<=[(=,:\[!&|?{};+])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
#: What hides braces, by language.
HIDDEN = {
    "javascript": [_LINE, _BLOCK, _REGEX, _DOUBLE, _SINGLE, _TEMPLATE],
    "rust": [_LINE, _BLOCK, r'b?r(#*)".*?(?:"\1|\Z)', _DOUBLE.replace(r"[^\"\\\n]", r"[^\"\\]"), _CHAR],
    "go": [_LINE, _BLOCK, r"`[^`]*(?:`|\Z)", _DOUBLE, _CHAR],
    "java": [_LINE, _BLOCK, r'""".*?(?:"""|\Z)', _DOUBLE, _CHAR],
    "c": [_LINE, _BLOCK, r'R"([^()\\\s]{0,16})\(.*?(?:\)\1"|\Z)', _DOUBLE, _CHAR],
}
HIDDEN |= {"typescript": HIDDEN["javascript"], "cpp": HIDDEN["c"]}
_W = r"[A-Za-z_$][\w$]*"
_TYPED = r"(?:[\w:<>,\[\]&*~?.@]+\s+(?:[*&]+\s*)?)+"
#: Heads of definitions, tried in order at each place of the blanked text: kind and pattern
#: with the name as its group.
HEADS = {
    "javascript": [("class", rf"\bclass\s+({_W})"), ("function", rf"\bfunction\b\s*\*?\s*({_W})\s*\("), ("function", rf"\b(?:const|let|var)\s+({_W})\s*=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*=>|{_W}\s*=>)"), ("method", rf"(?<![\w$.])(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*(#?{_W})\s*\([^()]*\)\s*(?={{)")],
    "rust": [("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("impl", r"\bimpl\b(?:\s*<[^{}]*?>)?\s+(?:[\w:<>, &']+?\s+for\s+)?(\w+)"), ("module", r"\bmod\s+(\w+)"), ("function", r"\bfn\s+(\w+)")],
    "go": [("function", r"\bfunc\s+(?:\([^()]*\)\s*)?(\w+)\s*[\[(]"), ("struct", r"\btype\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"\btype\s+(\w+)(?:\[[^\]]*\])?\s+interface\b")],
    "java": [("class", r"\b(?:class|record)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("method", rf"(?<![\w.]){_TYPED}(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w., ]+)?(?=[{{;])")],
    "c": [("struct", r"\b(?:struct|union)\s+(\w+)\s*(?={)"), ("class", r"\bclass\s+(\w+)"), ("namespace", r"\bnamespace\s+(\w+)"), ("enum", r"\benum\s+(?:class\s+)?(\w+)"), ("function", rf"(?<![\w.]){_TYPED}((?:\w+::)*~?\w+)\s*\([^()]*\)\s*(?:const\s*)?(?=[{{;])")],
}
HEADS |= {"typescript": [("interface", rf"\binterface\s+({_W})"), ("enum", rf"\benum\s+({_W})"), *HEADS["javascript"]], "cpp": HEADS["c"]}
#: Words before a bracket that name nothing.
WORDS = set("if for while switch catch return new throw else do try match loop func function fn sizeof typeof await yield in of case super this synchronized defer select import async".split())
SCHEMA = "path string, language string, kind string, name string, line_no int, end_line int, depth int, inside string"


def blanked(text: str, language: str) -> str:
    """``text`` with comments, strings and characters as blanks, of the same length."""
    rule = _compiled(language)
    return rule.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_rules: dict[str, re.Pattern] = {}


def _compiled(language: str) -> re.Pattern:
    if language not in _rules:
        parts, groups = [], 0
        for p in HIDDEN[language]:
            n = re.compile(p).groups
            parts.append(re.sub(r"\\1", rf"\\{groups + 1}", p) if n else p)
            groups += n
        _rules[language] = re.compile("|".join(parts), re.S)
    return _rules[language]


class Source:
    """A blanked text with its depths: by place, the open braces and brackets before it."""

    def __init__(self, text: str, language: str):
        self.text, self.language = blanked(text, language), language
        raw = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        step = lambda up, down: np.cumsum(np.isin(raw, [ord(c) for c in up]).astype(np.int64) - np.isin(raw, [ord(c) for c in down]))
        self.braces, self.rounds = step("{", "}"), step("([", ")]")
        self.opens, self.closes = np.flatnonzero(raw == ord("{")), np.flatnonzero(raw == ord("}"))
        self.ends = np.flatnonzero(raw == ord(";"))
        self.feeds = np.flatnonzero(raw == 10)
        self.by_depth: dict[int, np.ndarray] = {}

    def line(self, at: int) -> int:
        return int(np.searchsorted(self.feeds, at)) + 1

    def closing(self, at: int) -> int:
        """The brace that closes the one at a place; the end of the text if none does."""
        level = int(self.braces[at]) - 1
        if level not in self.by_depth:
            self.by_depth[level] = self.closes[self.braces[self.closes] == level]
        later = self.by_depth[level]
        k = np.searchsorted(later, at)
        return int(later[k]) if k < len(later) else len(self.text) - 1

    def body(self, head: int, start: int) -> tuple[int, int] | None:
        """Where the body of a definition opens and closes, or None if a semicolon, or the
        brace that closes what is around it, comes first."""
        level, rounds = int(self.braces[head - 1]) if head else 0, int(self.rounds[head - 1]) if head else 0
        for at in self.opens[np.searchsorted(self.opens, start) :]:
            stops = self.ends[np.searchsorted(self.ends, start) : np.searchsorted(self.ends, at)]
            if (self.braces[start:at] < level).any() or (self.rounds[stops] <= rounds).any():
                return None
            if self.rounds[at] == rounds:
                return int(at), self.closing(int(at))
            if at - start > 20_000:
                return None
        return None

    def symbols(self) -> list[tuple]:
        """(kind, name, start, opens, end) in order of their places."""
        found: dict[int, tuple] = {}
        for kind, pattern in HEADS[self.language]:
            for m in re.finditer(pattern, self.text):
                if m[1] in WORDS or m.start(1) in found or re.match(r"\s*(?:return|new|throw|else|case|goto|delete)\b", m[0]):
                    continue
                body = self.body(m.start(), m.end() if self.text[m.end() - 1] not in "([" else m.end() - 1)
                if body is None and kind in ("method", "impl", "module", "namespace") and self.language != "java":
                    continue
                stop = self.ends[np.searchsorted(self.ends, m.end()) :][:1]
                if body is None and kind == "function" and self.language in ("c", "cpp", "java") and self.braces[m.start()] > 0 and not self._in_type(m.start(), found):
                    continue  # a statement in a body
                found[m.start(1)] = (kind, m[1], m.start(1), body[0] if body else -1, body[1] if body else int(stop[0]) if len(stop) else m.end() - 1)
        return [found[k] for k in sorted(found)]

    def _in_type(self, at: int, found: dict) -> bool:
        around = [s for s in found.values() if s[3] >= 0 and s[3] < at < s[4]]
        return bool(around) and max(around, key=lambda s: s[3])[0] in ("class", "struct", "interface", "namespace")


def _per_file(files: DataFrame, of, schema: str, types: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = [(p, lang, *r) for p, lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in of(t, lang)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)

    own = files.where(F.col("text").isNotNull() & F.col("language").isin(*HIDDEN)).select(F.col("path").cast("string"), "language", F.col("text").cast("string"))
    return dealt(own).mapInArrow(run, schema)


def _nested(found: list[tuple]) -> list[tuple]:
    """Each symbol with the names of those around it, outermost first."""
    out, around = [], []
    for s in found:
        while around and around[-1][4] < s[2]:
            around.pop()
        out.append((*s, [a[1] for a in around]))
        if s[3] >= 0:
            around.append(s)
    return out


def symbols(files: DataFrame) -> DataFrame:
    """(path, language, kind, name, line_no, end_line, depth, inside) of the definitions of
    each file (path, language, text): ``end_line`` by nesting, ``inside`` the names around
    it, ``depth`` how many.  Null and empty texts and other languages have none; a
    body that nothing closes ends with the text."""

    def of(text: str, language: str) -> list[tuple]:
        if not text:
            return []
        source = Source(text, language)
        return [(kind, name, source.line(start), source.line(end), len(around), ".".join(around)) for kind, name, start, _, end, around in _nested(source.symbols())]

    return _per_file(files, of, SCHEMA, [*[pa.string()] * 4, *[pa.int32()] * 3, pa.string()])


def calls(files: DataFrame) -> DataFrame:
    """(path, language, name, line_no, inside): names before a bracket outside comments and
    strings that are no definition, with the innermost definition around them."""

    def of(text: str, language: str) -> list[tuple]:
        if not text:
            return []
        source = Source(text, language)
        own = source.symbols()
        heads = {s[2] for s in own}
        out = []
        for m in re.finditer(r"(?<![\w$])(?:[A-Za-z_$][\w$]*\s*(?:\.|::|->)\s*)*([A-Za-z_$][\w$]*)\s*!?\(", source.text):
            if m[1] in WORDS or m.start(1) in heads:
                continue
            around = [s for s in own if s[3] >= 0 and s[3] < m.start(1) <= s[4]]
            out.append((re.sub(r"\s", "", m[0][:-1]).rstrip("!"), source.line(m.start(1)), max(around, key=lambda s: s[3])[1] if around else ""))
        return out

    return _per_file(files, of, "path string, language string, name string, line_no int, inside string", [*[pa.string()] * 3, pa.int32(), pa.string()])
