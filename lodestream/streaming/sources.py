"""Stream sources for tests and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.functions.ids import clean_id
from lodestream.scratch import new_path

#: Schema of a folder of stream_users files.
STREAM_USERS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("user_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("arrived_at", T.TimestampNTZType()), T.StructField("city", T.StringType()), T.StructField("channel", T.StringType())])


def replay(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The parquet files of a folder as a stream, oldest first; ids cleaned, rows without one left out.

    ``ts`` is cast to a timestamp with zone (UTC session), as watermarks need one.
    """
    t = spark.readStream.schema(STREAM_USERS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return t.select("seq", clean_id("user_id").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "city", "channel").filter("user_id is not null")


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a streaming query over all that is there and gives what its last micro-batch puts out (in complete mode:
    everything). Results, and the query's own checkpoint, go to the shared folder."""
    spark, folder, last = stream.sparkSession, new_path(stream.sparkSession), []

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v{batch_id}")
        last[:] = [batch_id]

    stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark)).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/v{last[0]}") if last else spark.createDataFrame([], stream.schema)


def write_blocks(df: DataFrame, folder: str, block: int) -> None:
    """``df`` as one file per ``block`` order numbers, in order of modification, for :func:`replay`."""
    low, high = df.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return
    for start in range((low - 1) // block * block + 1, high + 1, block):
        df.filter(F.col("seq").between(start, start + block - 1)).coalesce(1).write.mode("append").parquet(folder)
