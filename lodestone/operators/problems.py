"""Problem texts: types, severities, components, scores, plans and their orders."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import dealt

#: Problem types with the words that tell them, the first that fits wins.
TYPES = [
    ("performance", ["langsam", "slow", "performance", "dauer", "zeit", "latenz", "verzögerung", "timeout", "häng", "block"]),
    ("missing_feature", ["fehl", "missing", "wolle", "brauch", "feature", "funktion", "könn", "sollte", "unterstütz"]),
    ("workflow_gap", ["manual", "manuell", "workflow", "schritt", "automat", "prozess", "ablauf", "kette", "mehrere"]),
    ("ux_issue", ["ui", "bedien", "übersicht", "unklar", "user", "oberfläche", "ansicht", "darstellung", "lesbar", "farbe"]),
    ("reliability", ["zuverläss", "stabil", "inkonsistent", "unvorhersehbar", "flaky", "intermittierend", "gelegentlich"]),
    ("integration_gap", ["integration", "schnittstelle", "api", "extern", "dienst", "service", "kommunikation", "verbindung"]),
    ("refactor_required", ["refactor", "struktur", "wartbar", "technisch", "schuld", "code qualität", "dupliziert"]),
    ("bug", ["bug", "fehler", "crash", "fail", "nicht", "exception", "error", "falsch", "kaputt", "defekt"]),
]
#: Words that set a severity before the type does, in this order.
SEVERITY_WORDS = [
    ("critical", ["kritisch", "critical", "notfall", "emergency", "produktiv", "production", "ausfall", "down", "datenverlust", "security", "sicherheit", "leck"]),
    ("high", ["hoch", "high", "dringend", "urgent", "wichtig", "block", "blocker", "verhindert", "unmöglich"]),
    ("low", ["niedrig", "low", "klein", "minor", "kosmetik", "optional", "nice to have", "gelegentlich"]),
]
#: The severity of a type where no word sets it; others are medium.
SEVERITY_OF = {"reliability": "high", "missing_feature": "low", "ux_issue": "low", "refactor_required": "low"}
#: Components with the words that name them.
COMPONENTS = {
    "scanner": ["scan", "analyse", "find", "detect", "prüfung"],
    "api": ["api", "endpoint", "route", "request", "response", "handler"],
    "ui": ["ui", "frontend", "oberfläch", "anzeige", "button", "gui", "menü"],
    "database": ["datenbank", "db", "query", "sql", "table", "schema"],
    "config": ["config", "einstellung", "parameter", "yaml", "konfig"],
    "logging": ["log", "report", "alert", "monitor", "trace"],
    "cache": ["cache", "puffer", "speicher", "redis", "memcached"],
    "agent": ["agent", "inference", "llm", "modell", "ki", "ai"],
}
#: The catalogue of words by type; a word that stands twice counts twice.
CATALOG = {
    "performance": ["langsam", "slow", "performance", "dauer", "zeit", "latenz", "timeout", "häng", "freeze", "verzögerung", "optimier", "speicher", "cpu", "auslastung", "ineffizient", "block", "antwortzeit", "throughput", "skalier"],
    "reliability": ["zuverlässig", "reliability", "stabil", "instabil", "crash", "absturz", "fehleranfällig", "ausfall", "verfügbarkeit", "inkonsistent", "unvorhersehbar", "flaky", "intermittierend"],
    "missing_feature": ["fehl", "missing", "wolle", "brauch", "feature", "funktion", "support", "unterstütz", "export", "import", "automatisch", "könn", "sollte", "möglichkeit", "option"],
    "workflow_gap": ["manuell", "manual", "workflow", "schritt", "automat", "prozess", "ablauf", "wiederhol", "jedes mal", "kette", "mehrere", "hintereinander", "kopier"],
    "integration_gap": ["integration", "schnittstell", "api", "connect", "sync", "datenübertrag", "format", "konvertier", "kompatibel", "extern", "dienst", "service", "kommunikation", "protokoll"],
    "ux_issue": ["ui", "bedien", "übersicht", "unklar", "user", "intuitiv", "verwirr", "kompliziert", "umständlich", "klick", "menü", "oberfläche", "ansicht", "darstellung", "lesbar", "farbe", "frontend", "gui", "navigation"],
    "bug": ["bug", "fehler", "fail", "nicht", "falsch", "broken", "defekt", "funktions", "exception", "error", "crash", "kaputt", "exception", "traceback", "stacktrace"],
    "refactor_required": ["refactor", "struktur", "code", "wartbar", "tech debt", "qualität", "duplizier", "unübersichtlich", "technisch", "schuld", "clean", "architektur", "modular"],
}
#: Types of sub-problems, of solutions and of patterns by words.
SUBTYPES = [("analysis", ["analyse", "untersuch", "research"]), ("testing", ["test", "validier"]), ("documentation", ["dokument", "doc"]), ("integration", ["integrat", "adapter", "connector"]), ("configuration", ["config", "einstell"]), ("refactoring", ["refactor", "struktur"])]
SOLUTIONS = [("hotfix", ["hotfix", "minimal"]), ("refactor", ["refactor"]), ("rewrite", ["neu", "rewrite"]), ("config_change", ["config"]), ("guard", ["guard", "fallback"]), ("automation", ["automat"])]
BUG_SEVERITY = [("critical", ["critical", "security", "injection"]), ("high", ["high", "error", "bug"]), ("medium", ["medium", "warning"])]
#: The cost of a risk in the score of a solution.
RISK = {"low": 2, "medium": 5, "high": 8, "critical": 10}
#: Steps of this engine by problem type, in order.
PLANS = {
    "bug": ["reproduce the fault", "find its cause", "repair it", "add a test"],
    "performance": ["measure", "find the hot path", "improve it", "measure again"],
    "missing_feature": ["write the need down", "design it", "build it"],
    "ux_issue": ["watch a user", "change the view"],
    "unknown": ["ask for details"],
}


def has_any(low: Column, words: list[str]) -> Column:
    """Whether a lower-cased text contains one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def first_fit(low: Column, ladder: list[tuple[str, list[str]]], last: str) -> Column:
    """The name of the first step of which a word is in the text; null text: ``last``."""
    out = F.lit(last)
    for name, words in reversed(ladder):
        out = F.when(has_any(low, words), name).otherwise(out)
    return out


def severity(low: Column, kind: Column) -> Column:
    """By the words first, then by the type."""
    by_type = F.lit("medium")
    for k, v in SEVERITY_OF.items():
        by_type = F.when(kind == k, v).otherwise(by_type)
    out = by_type
    for name, words in reversed(SEVERITY_WORDS):
        out = F.when(has_any(low, words), name).otherwise(out)
    return out


def components(low: Column, existing: Column | None = None, table: dict = COMPONENTS) -> Column:
    """The sorted distinct components that the text names, with ``existing`` ones."""
    found = F.filter(F.array(*[F.when(has_any(low, words), c) for c, words in table.items()]), lambda x: x.isNotNull())
    return F.array_sort(F.array_union(existing, found) if existing is not None else F.array_distinct(found))


def matched(low: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def scores(low: Column, catalog: dict = CATALOG) -> Column:
    """An array of (kind, matches, score): the share of a type's words in the text."""
    low = F.coalesce(low, F.lit(""))
    return F.array(*[F.struct(F.lit(k).alias("kind"), matched(low, w).alias("matches"), (matched(low, w) / len(w)).alias("score")) for k, w in catalog.items()])


def problem_confidence(matches: Column, indicators: Column) -> Column:
    """min(.3 + .05 matches, .7) + .1 an indicator, at most .95."""
    return F.round(F.least(F.least(F.lit(0.3) + matches * 0.05, F.lit(0.7)) + indicators * 0.1, F.lit(0.95)), 2)


def evidence_sentences(text: Column, words: list[str], most: int = 5) -> Column:
    """For each word the first sentence that has it, in the order of the words, at most
    ``most`` (the report's length)."""
    parts = F.split(text, r"\.")
    contains = lambda w: lambda s: F.lower(s).contains(w)
    hits = F.array(*[F.concat(F.trim(F.try_element_at(F.filter(parts, contains(w)), F.lit(1))), F.lit(".")) for w in words])
    return F.slice(F.filter(hits, lambda x: x.isNotNull()), 1, most)


def code_indicators(low: Column) -> Column:
    """A map of weights: waits and locks, a try without a handler, deep nesting."""
    breaks = F.length(low) - F.length(F.replace(low, F.lit("\n"), F.lit("")))
    steps = (F.length(low) - F.length(F.replace(low, F.lit("    "), F.lit("")))) / 4
    flags = F.create_map(
        F.lit("performance_risk"), F.when(has_any(low, ["while true", "sleep", "timeout", "lock"]), 0.5),
        F.lit("error_handling_gap"), F.when(low.contains("try:") & ~low.contains("except"), 0.3),
        F.lit("complexity_high"), F.when((breaks > 0) & (F.floor(F.try_divide(steps, breaks)) > 4), 0.4),
    )
    return F.map_filter(flags, lambda _, v: v.isNotNull())


def issue_priority(kind: Column, severity_: Column) -> Column:
    """1 to 5 by type and severity; a security issue of low severity goes by severity."""
    secure = F.when(severity_ == "CRITICAL", 1).when(severity_ == "HIGH", 2).when(severity_ == "MEDIUM", 3)
    every = F.when(severity_ == "ERROR", 2).when(severity_ == "HIGH", 3).when(severity_ == "MEDIUM", 4).otherwise(5)
    return F.coalesce(F.when(kind == "security", secure), every)


def bug_type(hits: Column, cc: Column, churn: Column, path: Column) -> Column:
    """The first factor that says something, else words of the path."""
    low = F.lower(path)
    by_path = F.when(low.contains("security"), "security_critical").when(low.contains("auth"), "auth_critical").when(low.contains("db") | low.contains("database"), "database_critical").otherwise("code_quality")
    return F.when(hits > 0, "semgrep_security").when(cc >= 15, "high_complexity").when(cc >= 10, "medium_complexity").when(churn >= 10, "high_churn").when(churn >= 5, "medium_churn").otherwise(by_path)


def solution_score(effectiveness: Column, invasiveness: Column, risk: Column, effort: Column, testability: Column) -> Column:
    """Mean of the gains minus mean of the costs, plus 5, within 0 and 10."""
    cost = F.lit(5)
    for k, v in RISK.items():
        cost = F.when(risk == k, v).otherwise(cost)
    raw = (effectiveness + testability) / 2 - (invasiveness + cost + effort) / 3 + 5
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw))


def filtered(rows: DataFrame, order: list[Column], **equal) -> DataFrame:
    """Rows that equal every given value (None: any), in the order."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(*order)


def execution_order(items: DataFrame, plan: str = "plan", item: str = "id", priority: str = "priority", needs: str = "needs") -> DataFrame:
    """(plan, id, position): Kahn's order of each plan.  Of the ready items the one of
    the least priority comes next, ties by the order in which they became ready (at
    first by id); items of cycles, or that need an unknown item, follow by priority.

    ``needs`` is an array of ids.  The order of a plan is sequential by nature, so a
    plan is one task's; plans are dealt over the tasks, and many go to Python at once.
    A missing priority comes last.
    """
    own = items.select(plan, item, priority, needs)
    out = T.StructType([own.schema[plan], own.schema[item], T.StructField("position", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        found = []
        for key, group in itertools.groupby(rows, key=lambda row: row[0]):
            found += [(key, i, n) for n, i in enumerate(_kahn(list(group)), 1)]
            if len(found) >= 10_000:
                yield _batch(found, schema)
                found = []
        if found:
            yield _batch(found, schema)

    return dealt(own, plan).sortWithinPartitions(F.col(plan), F.asc_nulls_last(item)).mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _kahn(rows: list[tuple]) -> list:
    """The ids of one plan's rows (plan, id, priority, needs), which are sorted by id."""
    ids, ranks = [r[1] for r in rows], {r[1]: math.inf if r[2] is None else r[2] for r in rows}
    left, after = {}, {}
    for _, i, _, n in rows:
        left[i] = len(n or ())
        for x in n or ():
            after.setdefault(x, []).append(i)
    ready = [(ranks[i], k, i) for k, i in enumerate(i for i in ids if not left[i])]
    heapq.heapify(ready)
    out, seq = [], len(ready)
    while ready:
        _, _, i = heapq.heappop(ready)
        out.append(i)
        for x in after.get(i, ()):
            left[x] -= 1
            if not left[x]:
                heapq.heappush(ready, (ranks[x], seq, x))
                seq += 1
    done = set(out)
    return out + sorted((i for i in ids if i not in done), key=ranks.get)
