"""Flatfiles as a stream: new files in a folder are parsed as they come and appended to the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions.columns import derive
from strandline.sources.flatfile import parse_texts, tables


def stream_texts(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """path and value of each file that comes into the folder."""
    raw = spark.readStream.format("text").schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("value"))


def ingest(spark: SparkSession, folder: str, lake: str, checkpoint: str) -> StreamingQuery:
    """Appends records and flat features of new files; a batch that is repeated after a failure overwrites its own part."""

    def store(batch: DataFrame, number: int) -> None:
        parsed = parse_texts(batch).persist()
        records, features = tables(parsed)
        records.write.mode("overwrite").parquet(f"{lake}/records/batch={number}")
        derive(features).write.mode("overwrite").parquet(f"{lake}/features/batch={number}")
        parsed.unpersist()

    return stream_texts(spark, folder).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
