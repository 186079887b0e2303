"""The driver's tables, and bounded batches for long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """From now on at most so many texts, and no more than about so many bytes, go to a Python worker at once; a batch of long texts would not fit its memory."""
    for key, most in ((_BATCH, rows), (_BYTES, size)):
        now = int(spark.conf.get(key).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
