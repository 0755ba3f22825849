"""The corpus pipeline: quality, copies, benchmark, mix, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet to the shared folder and reads them for the next.
All stages but the last return the columns of ``documents``, further columns that
the table has too, whatever their names.  Rows with a null in any column pass by the
rules below; repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from lodestone.llm import binary, common, decontam, mixing, neardup, quality


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rule or the calibrated forest rejects go; null and
    empty texts have no words and go."""
    return quality.filtered(docs, common.read(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group that five-word shingles link at 0.8 stays: the one
    with the smallest id (null last); texts without words are linked with nothing."""
    return neardup.deduplicated(docs, n=5, percent=80)


def decontaminated(spark, docs, sf_dir):
    """Documents that hold a ten-word window of a benchmark item go; a null text
    holds none."""
    return decontam.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def source_mix(spark, docs, sf_dir):
    """Each document as often as the mix of sources takes it; null is a source of
    its own, ties of the hash are taken together, a text without words never."""
    return mixing.mixed_rows(docs)


def token_files(spark, docs, sf_dir):
    """The token ids in packed files; a row per document read back from them, in
    ascending id, null first; a null text is its end id only."""
    return binary.read(binary.write(docs, binary.public(), binary.VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_files),
]

#: The forest, the signatures and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
