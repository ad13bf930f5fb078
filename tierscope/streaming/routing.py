"""Directory streams of requests, scored as they arrive with a frozen router."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import routing_features
from ..plans.frozen import Frozen
from ..sources.io import parsed


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """New JSON-lines files in a folder as a stream of parsed requests."""
    lines = spark.readStream.text(path).select("value", F.col("_metadata.file_name").alias("dataset"))
    return parsed(lines.filter(F.trim("value") != ""))


def route_stream(frozen: Frozen, stream: DataFrame, out: str, checkpoint: str, method: str = "blend") -> StreamingQuery:
    """Route arriving requests (each a task's first call) and write their tiers; stateless, one run over what is there."""

    def batch(df: DataFrame, epoch: int) -> None:
        rows = df.withColumn("trajectory_id", F.coalesce("trajectory_id", F.monotonically_increasing_id()))
        frozen.route(routing_features(rows), method).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
