"""Requests linked to trajectories as they arrive, across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.trajectories import chain_heads


def link_stream(stream: DataFrame, home: str, checkpoint: str) -> StreamingQuery:
    """Link arriving requests (pos, key, hashes) under ``home``, one run over what is there.

    The state is a table of all requests so far, by epoch. A micro-batch adds its own and links
    anew only the groups whose keys it brings, since no chain leaves its group; each request's last
    epoch counts. An epoch that is run again after a failure overwrites what it wrote.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        df.select(F.col("pos").cast("long").alias("pos"), F.col("key").cast("string").alias("key"), "hashes").write.mode("overwrite").parquet(f"{home}/requests/epoch={epoch}")
        every = spark.read.parquet(f"{home}/requests").filter(F.col("epoch") <= epoch)
        new = every.filter(F.col("epoch") == epoch).drop("epoch")
        keys = new.select("key").distinct()  # null keys don't join: such requests stand alone
        touched = every.drop("epoch").join(keys, "key", "left_semi").unionByName(new.filter("key is null"))
        chain_heads(touched).write.mode("overwrite").parquet(f"{home}/chains/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def linked_so_far(spark: SparkSession, home: str) -> DataFrame:
    """(pos, key, head, call_index) of all requests that have arrived: what the batch gives on the same requests, however they were split."""
    rows = spark.read.parquet(f"{home}/chains").groupBy("pos").agg(F.max_by(F.struct("n", "key", "head"), "epoch").alias("c")).select("pos", "c.*")
    return rows.withColumn("call_index", F.row_number().over(Window.partitionBy("head").orderBy("n", "pos"))).drop("n")
