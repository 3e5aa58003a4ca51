"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes all that its predecessor kept.  The first four return the
columns of ``documents``; the last returns the pieces of packed sequences.
Personal data is masked in place, repeated passages are cut out, so both
change ``text`` and ``n_chars`` but keep every row.

In every stage a null text counts as empty and stays null, columns that aren't asked for stay
as they are whatever their names, texts of any length are read whole, and an
empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jobstrata.llm import minhash, packing, pii, rules, suffixes
from jobstrata.llm.common import staged, table

#: Near copies share at least this percentage of their five-word runs.
SIMILAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules accept; those without a text, or an empty one, are too short and go."""
    return rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the rows of the smallest doc_id: repeated rows of that id stay
    together; rows without an id are a group each, and so are texts without words."""
    return minhash.one_of_each(docs, SIMILAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that stand earlier; rows without an id are neither
    searched nor changed, and a text that is removed altogether is empty."""
    return suffixes.without_repeats(docs, n_chars_col="n_chars")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each span replaced by its kind; where spans overlap, the earlier one counts."""
    return pii.masked(docs, n_chars_col="n_chars")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a row without a text is its end mark alone, each row is packed on its own."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
