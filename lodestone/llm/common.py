"""What the corpus operators share: tables, the shared folder, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rule: space and U+0009..U+000D.  ``bytes.split()``
#: without arguments splits on exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only in local mode, where the session names none (tests), one is made here:
    on a cluster a folder of this machine would be lost to the executors.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the
    lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_bytes(c: str) -> Column:
    """A text column as UTF-8 bytes; null becomes the empty text."""
    return F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")


def nested(column: str) -> str:
    """The name of a column inside ``__row``."""
    return f"__row.`{column}`"


def as_row(docs: DataFrame, *extra: Column) -> DataFrame:
    """``docs`` as one struct column ``__row``, so that no column that an operator
    adds can clash with one of its own; ``select("__row.*")`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *extra)


def append(df: DataFrame, schema: T.StructType, text: Column, make: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """``df`` with further columns computed by Python workers, batch by batch.

    ``make()`` runs once in each task and returns a function from a batch's
    values of ``text`` to a dict with a list per new column.  The input column
    travels under a name of its own, so no column of ``df`` can clash with it;
    a column of ``df`` named like a new one is replaced.
    """
    names = [f.name for f in schema]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], text.alias("__in"))
    out = T.StructType([*kept.schema.fields[:-1], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        new = to_arrow_schema(schema)
        f = make()
        for batch in batches:
            got = f(batch.column(batch.num_columns - 1).to_pylist())
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [pa.array(got[c.name], c.type) for c in new]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return kept.mapInArrow(run, out)
