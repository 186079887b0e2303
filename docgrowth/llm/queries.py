"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrowth.llm import align, ann, decontam, html, jaccard, langid, packing, pii, search, suffixes, tokens, toxicity, urls
from docgrowth.llm.tables import table


def _in_split(key: str, parts: int, held: int):
    """Whether a row is held out: the checksum of its id as text, by remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == held, F.lit(False))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs).select("doc_id", "pii.*")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100, top=10)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=4096, end_id=1)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op7_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.packed(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=4096, end_id=1)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _in_split("doc_id", 4, 2))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "language.*")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~_in_split("doc_id", 3, 1)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _in_split("doc_id", 3, 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), length=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_nearest, op3_packing, op4_jaccard_join, op5_decontamination, op6_url_filter, op7_token_matrix, op8_language, op9_main_text, op10_toxicity, op11_ranked_search, op12_alignment, op13_suffix_dedup)}
ORACLE: dict[str, str] = {"op6_url_filter": urls.SQL, "op11_ranked_search": search.SQL}
