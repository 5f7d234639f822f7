"""The corpus pipeline: filter, deduplicate, decontaminate and pack documents.

Each stage reads what its predecessor wrote. All but the last return the columns of
``documents``; the last returns packed pieces. Further columns, whatever their names, travel along up to
the last stage; an empty table goes through all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import toxicity
from corvane.llm.common import materialise, table
from corvane.llm.decontamination import remove_contamination
from corvane.llm.exact_dedup import drop_exact_copies
from corvane.llm.near_dup import drop_near_duplicates
from corvane.llm.packing import pack, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The model is fitted on labelled rows of ``docs``.

    Each row goes by its own text, whatever its id; null and empty texts have the score of the bias, below
    0.7 unless most labelled rows are toxic. Labels without an id or a value are left out; without any
    labels all documents stay.
    """
    model = toxicity.train(docs, toxicity.toxic_labels(table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays, and repeats of that row with it. Null counts as empty.

    A row without an id goes if a row with one has its text; otherwise it stays.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id, and repeats of that row with it.

    Rows without an id and texts without words stay.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows are cut out of every row, whatever its id; rows left without words by that go.

    Null and empty texts stay as they are.
    """
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row in sequences of at most 1024 tokens. Null and empty texts are the end id alone."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: The first stage is a learned model, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
