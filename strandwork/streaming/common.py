"""Running a stream over what is there and reading the result."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandwork.session import shared_folder


#: Parts that the keys of a state machine are dealt into; a part's keys are one state.
PARTS = 16_384


def part_of(key: str) -> Column:
    """The part of a key. A call of Python for every single key costs far more than its few rows."""
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("part")


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/stream-{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, name: str, per_batch: int | None = None) -> DataFrame:
    """One parquet table as a file stream."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def drain(df: DataFrame, name: str, mode: str = "append", place: str | None = None) -> DataFrame:
    """Run an append stream to the end of its input into parquet (exactly once) and read it back.

    ``place`` is a folder that outlives the run: called with it again, the stream goes on where it stopped.
    """
    spark = df.sparkSession
    place = place or folder(spark, name)
    out, log = f"{place}/rows", f"{place}/log"
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def drain_each(df: DataFrame, name: str, step, mode: str = "append", place: str | None = None) -> None:
    """Run a stream to the end of its input through ``step(batch, batch_id)``; with ``place`` it goes on where it stopped."""
    log = f"{place or folder(df.sparkSession, name)}/log"
    df.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def drain_last(df: DataFrame, name: str) -> DataFrame:
    """Run an aggregation to the end of its input and read its final complete result."""
    spark = df.sparkSession
    base, seen = folder(spark, name), []

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{batch_id}")
        seen.append(batch_id)

    drain_each(df, name, step, "complete")
    return spark.read.schema(df.schema).parquet(f"{base}/{max(seen)}")
