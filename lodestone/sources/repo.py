"""Trees of source files: scan, entry points, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths

#: Languages with their suffixes, and the files that start a program.
SUFFIXES = {"python": [".py", ".pyw"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "typescript": [".ts", ".tsx"], "rust": [".rs"], "go": [".go"], "java": [".java"], "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hh"], "csharp": [".cs"]}
ENTRIES = {"python": ["main.py", "__main__.py", "app.py", "wsgi.py", "asgi.py"], "javascript": ["index.js", "main.js", "app.js", "server.js"], "typescript": ["index.ts", "main.ts", "app.ts"], "rust": ["main.rs", "lib.rs"], "go": ["main.go"], "java": ["Main.java", "Application.java"]}
#: Directories that a scan leaves out.
PRUNED = [".git", "node_modules", "__pycache__", "build", "dist", "target"]


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column) -> Column:
    """The language of a path's suffix, null for others."""
    known = F.create_map(*[F.lit(x) for lang, own in SUFFIXES.items() for s in own for x in (s, lang)])
    return F.try_element_at(known, paths.suffix(path))


def entry_point(path: Column) -> Column:
    out = F.lit(False)
    for names in ENTRIES.values():
        out = out | name_of(path).isin(names)
    return out


def scan(spark: SparkSession, root: str, pruned: list[str] = PRUNED, globs: tuple[str, ...] = (), most: int | None = None, relative=None) -> DataFrame:
    """(path, language, size, text) of the source files below ``root``, read by Spark so
    that any store works; which files by ``sources``.

    ``relative`` maps the column of a file's location to its path in the tree (by default
    what follows ``root``).  A file costs a store tens of milliseconds however small it
    is: very many small ones are better kept as rows of a table, for ``sources``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").rpartition("://")[2].split(":", 1)[-1].lstrip("/")
    path = relative(F.col("path")) if relative else F.regexp_replace(F.col("path"), r"^.*?" + base + "/", "")
    return sources(files.select(path.alias("path"), "content"), pruned, globs, most)


def sources(files: DataFrame, pruned: list[str] = PRUNED, globs: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(path, language, size, text) of the source files among ``files`` (path, content: the
    bytes), in one narrow pass.

    Only files with a known suffix, in no pruned directory, that no glob names; with
    ``most`` the first by path.  Bytes that are no UTF-8 are replaced.
    """
    out = files.select("path", F.octet_length("content").cast("long").alias("size"), "content").withColumn("language", language_of(F.col("path"))).where("language is not null")
    if pruned:
        out = out.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, pruned))))
    if globs:
        out = out.where(~paths.ignored(F.col("path"), list(globs)))
    if most is not None:
        out = out.orderBy("path").limit(most)
    return out.select("path", "language", "size", F.decode(F.regexp_replace(F.col("content").cast("string"), "\r\n", "\n").cast("binary"), "UTF-8").alias("text"))


def manifest(files: DataFrame) -> DataFrame:
    """(language, files, lines) of scanned files."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("lines"))


def packed(files: DataFrame, group: Column, budget: int = 4_000_000) -> DataFrame:
    """(pack, part, text, tokens): the files of each group as text with their paths, in
    order, in parts of some ``budget`` characters so that no row grows with the group;
    tokens are a fourth of the characters."""
    from pyspark.sql import Window

    own = files.select(group.alias("pack"), "path", F.concat(F.lit("# "), F.col("path"), F.lit("\n"), F.col("text")).alias("t"))
    w = Window.partitionBy("pack").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum(F.length("t")).over(w), F.lit(0)) / budget).alias("part")
    rows = own.select("pack", part, F.struct("path", "t").alias("f"))
    out = rows.groupBy("pack", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["t"]), "\n").alias("text"))
    return out.withColumn("tokens", F.floor(F.length("text") / 4))
