"""Extension points: functions from tables to tables, registered by name.

An agent takes a table of files and gives findings; an analyser takes the columns of
a file and gives rows; a refactoring tells whether it applies to a text and rewrites
it.  ``Workflow`` chains steps with conditions and bounded loops on the driver; the
rows stay distributed.  Tracers that execute code and remote model providers are out
of scope.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources.tables import dealt, written

FINDING = "file string, line_no long, rule string, severity string"
_COLUMNS = ["file", "line_no", "rule", "severity"]


@dataclass
class Registry:
    """Agents, analysers and refactorings by name."""

    agents: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    analysers: dict[str, Callable[[str, str], list[tuple]]] = field(default_factory=dict)
    refactorings: dict[str, tuple[Callable[[str], bool], Callable[[str], str]]] = field(default_factory=dict)

    def agent(self, name: str):
        """A decorator: files (file, text) -> findings."""
        return lambda f: self.agents.setdefault(name, f)

    def analyser(self, name: str):
        """A decorator: (file, text) -> rows (line_no, rule, severity)."""
        return lambda f: self.analysers.setdefault(name, f)

    def refactoring(self, name: str, applies: Callable[[str], bool]):
        """A decorator: text -> text, where ``applies``."""
        return lambda f: self.refactorings.setdefault(name, (applies, f))

    def findings(self, files: DataFrame) -> DataFrame:
        """(agent, file, line_no, rule, severity) of every agent and analyser; one
        narrow pass for all analysers, a union with the agents."""
        analysers = dict(self.analysers)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(name, file, *r) for file, text in zip(batch["file"], batch["text"], strict=True) if text is not None for name, f in analysers.items() for r in f(file, text)]
                yield pd.DataFrame(rows, columns=["agent", *_COLUMNS])

        parts = [f(files).select(F.lit(name).alias("agent"), *_COLUMNS) for name, f in self.agents.items()]
        if analysers:
            parts.append(dealt(files.select("file", "text")).mapInPandas(run, f"agent string, {FINDING}"))
        return reduce(DataFrame.unionByName, parts)

    def refactored(self, files: DataFrame) -> DataFrame:
        """``files`` with the text after every refactoring that applies, in the order of
        registration, and ``applied``, their names."""
        chain = list(self.refactorings.items())
        schema = f"file {files.schema['file'].dataType.simpleString()}, text string, applied array<string>"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts, names = [], []
                for text in batch["text"]:
                    done = []
                    for name, (applies, rewrite) in chain:
                        if text is not None and applies(text):
                            text = rewrite(text)
                            done.append(name)
                    texts.append(text)
                    names.append(done)
                yield pd.DataFrame({"file": batch["file"], "text": texts, "applied": names})

        return dealt(files.select("file", "text")).mapInPandas(run, schema)


@dataclass
class Step:
    """A table to a table, and where its rows go: (next step, condition); rows that no
    condition takes go to ``END``."""

    run: Callable[[DataFrame], DataFrame]
    ways: list[tuple[str, str]]
    most: int | None = None  # how often a row may come here


END = "end"


class Workflow:
    """Steps over rows in bulk: in each round the rows of a step pass it together, and
    a row may come to a step at most ``most`` times."""

    def __init__(self, steps: dict[str, Step], first: str):
        self.steps, self.first = steps, first

    def __call__(self, rows: DataFrame, rounds: int | None = None) -> DataFrame:
        """``rows`` as the steps leave them, with ``state`` (the last step), ``visits``
        (steps taken) and ``ended``.  It goes on until no row is under way; where
        ``rounds`` are given, rows still under way after them come back too, with
        the step that they wait for as their state.  Each round is written."""
        now = rows.withColumn("state", F.lit(self.first)).withColumn("last", F.lit(self.first)).withColumn("visits", F.lit(0)).withColumn("seen", F.create_map().cast("map<string,int>"))
        done, turn = [], 0
        while rounds is None or turn < rounds:
            turn += 1
            moved = []
            for name, step in self.steps.items():
                own = now.where(F.col("state") == name)
                count = F.coalesce(F.try_element_at("seen", F.lit(name)), F.lit(0)) + 1
                out = step.run(own).withColumn("visits", F.col("visits") + 1).withColumn("seen", F.map_concat(_without(name), F.create_map(F.lit(name), count))).withColumn("last", F.lit(name))
                to = F.lit(END)
                for target, condition in reversed(step.ways):
                    most = self.steps[target].most if target in self.steps else None
                    fits = F.expr(condition)
                    if most is not None:
                        fits = fits & (F.coalesce(F.try_element_at("seen", F.lit(target)), F.lit(0)) < most)
                    to = F.when(fits, target).otherwise(to)
                moved.append(out.withColumn("state", to))
            every = written(reduce(DataFrame.unionByName, moved), "round")
            done.append(every.where(F.col("state") == END).withColumn("state", F.col("last")).withColumn("ended", F.lit(True)))
            now = every.where(F.col("state") != END)
            if now.isEmpty():
                break
        else:
            done.append(now.withColumn("ended", F.lit(False)))
        return reduce(DataFrame.unionByName, done).drop("last", "seen")


def _without(name: str):
    return F.map_filter("seen", lambda k, v: k != name)


def shards(files: DataFrame, least: int = 200_000) -> DataFrame:
    """(directory, lines, shard) of files (path, lines): a shard a top directory where
    there are ``least`` lines and two directories, else one shard."""
    by = files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("directory")).agg(F.sum("lines").alias("lines"))
    total = by.agg(F.sum("lines").alias("t"), F.count(F.lit(1)).alias("d"))
    split = (F.col("t") >= least) & (F.col("d") >= 2)
    return by.crossJoin(F.broadcast(total)).select("directory", "lines", F.when(split, F.col("directory")).otherwise("all").alias("shard"))  # one row
