"""Chunks that keep arriving: each micro-batch is reduced to its latest deliveries and appended; readers see the latest of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(chunks: DataFrame, *then) -> DataFrame:
    order = Window.partitionBy("chunk_id").orderBy(F.desc_nulls_last("indexed_at"), *then)
    return chunks.where("chunk_id is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ingest(spark: SparkSession, folder: str, schema, target: str, state: str) -> StreamingQuery:
    """Append the latest delivery of each chunk of every new file to ``target``; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The latest delivery of each chunk over all batches; of equally late ones that of the later batch."""
    return latest(spark.read.parquet(target), F.desc("batch")).drop("batch")
