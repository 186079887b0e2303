"""Training-corpus pipeline: language, near copies, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's documents. All but the last return the columns of documents, whatever
others there are, and all of them work on whole texts. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgrowth.functions.shared import forgotten, written
from docgrowth.llm import stages
from docgrowth.llm.queries import tokenizer_file
from docgrowth.llm.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts, texts without a letter and near ties between two languages go."""
    return stages.known_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) the document of smallest id; empty texts and null ids stay, rows alike in id and text stay once."""
    return stages.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage of 12 words (or a whole shorter item) with the benchmark; null texts and ids stay."""
    return stages.not_in_benchmark(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text masked and n_chars counted anew; null texts stay as they are."""
    return stages.without_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' token pieces in sequences of 4,096; null text is empty and has the end token only."""
    return stages.packed(docs, tokenizer_file())


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Learned and sketch-based stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:  # the table before this stage's is not read again
            forgotten(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
