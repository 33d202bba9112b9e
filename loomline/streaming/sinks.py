"""Streams to their end, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import store


def events(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """The files of a table as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream gives for all that is there now, written into the folder that driver and executors share and read
    again. State and progress stand beside it, so that a query that breaks off goes on from there."""
    spark = stream.sparkSession
    path = store.path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
