"""Stages of a corpus pipeline: each takes documents and returns the documents it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrowth.functions.shared import written
from docgrowth.llm import decontam, jaccard, langid, packing, pii
from docgrowth.llm.tables import bounded_batches

_OF_STAGE = "_language_of_stage"


def known_language(docs: DataFrame, near: float = 0.02) -> DataFrame:
    """Documents with a language: not `und`, and its codeword nearer than the runner-up's by at least `near`. The labels of docs teach the model."""
    if _OF_STAGE in docs.columns:
        raise ValueError(f"documents already have a column {_OF_STAGE}")
    bounded_batches(docs.sparkSession)
    model = langid.fit(docs)
    kept = langid.predict(docs, model, near=near, into=_OF_STAGE)
    return kept.filter((F.col(f"{_OF_STAGE}.lang_pred") != langid.UNKNOWN) & ~F.col(f"{_OF_STAGE}.ambiguous")).select(docs.columns)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the document with the smallest id; rows alike in id and text once. Null ids stay."""
    bounded_batches(docs.sparkSession)
    found = written(jaccard.near_copies(docs).select("doc_id", "component_id"), "groups")
    dropped = found.filter("doc_id <> component_id").select("doc_id").distinct()
    dropped = written(dropped, "dropped")
    small = dropped.count() <= jaccard.BROADCAST_IDS
    kept = docs.join(F.broadcast(dropped) if small else dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = written(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def not_in_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without overlap with any benchmark item; null and empty texts and null ids stay, all rows of an id go if one overlaps."""
    bounded_batches(docs.sparkSession)
    return decontam.without_benchmark(docs, benchmark)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """All documents, with spans of personal data masked and n_chars that of the masked text."""
    bounded_batches(docs.sparkSession)
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))).select(docs.columns)


def packed(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """Pieces of all documents in sequences, as docgrowth.llm.packing.pack gives them; every row has its own, repeated ones too."""
    bounded_batches(docs.sparkSession)
    return packing.pack(docs, path, capacity=capacity, end_id=1)
