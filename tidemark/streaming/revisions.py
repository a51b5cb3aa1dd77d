"""Streams of sentences: ingest of diff rows with a running keep rate, late rows told by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import text as X


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A folder of parquet files as a stream, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def keep_rates(rows: DataFrame, time: str = "made_at", text: str = "text", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """``window, n_sentences, n_kept`` by time; rows later than the watermark are passed over."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    kept = X.sent_filter(F.coalesce(F.col(text), F.lit("")))
    return timed.groupBy(F.window(time, window).alias("window")).agg(F.count("*").alias("n_sentences"), F.count_if(kept).alias("n_kept"))


def first_rows(rows: DataFrame, keys: list[str], time: str = "made_at", late: str = "7 days") -> DataFrame:
    """Each key once within the watermark: repeated rows under new ids are dropped."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
