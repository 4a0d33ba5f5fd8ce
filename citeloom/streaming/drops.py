"""Incremental audit input: dropped .bib files or delivered tables as a stream.

Entries are told apart by their content hash; a watermark bounds the state that redelivery needs.  Each
micro-batch goes to a cache table, so a restarted stream repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deliveries(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Parquet files of delivered rows as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def new_entries(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Entries not delivered within the delay before; entries that cite the same work stay apart."""
    return stream.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["entry_id"])


def bib_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole .bib files as they are dropped into a folder."""
    return spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.bib").text(path).select(F.input_file_name().alias("bib_file"), F.col("value").alias("text"))


def delivery_counts(stream: DataFrame, window: str = "30 days", delay: str = "30 days") -> DataFrame:
    """Deliveries per window of their load time; late rows within the delay still count."""
    return stream.withWatermark("loaded_at", delay).groupBy(F.window("loaded_at", window).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


def append_to(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch to a parquet table; exactly once per checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
