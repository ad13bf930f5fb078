"""Shared folder, written tables and the label fold used by the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local master, where everything runs on one machine, may fall back to a
    temporary folder when the setting is absent.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tierscope-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, object]):
    """The session with these settings; afterwards with its own again."""
    told = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in told.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later steps survive lost executors.

    The shuffle files of the write are removed at its end: nothing reads them any more.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with settings(spark, {_CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that no later step reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_folder(df.sparkSession, folder)


def free_name(wanted: str, taken) -> str:
    """``wanted``, with underscores before it until no column of ``taken`` has the name, upper or lower case."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def broadcast_if_small(df: DataFrame, n_rows: int, most: int = 500_000) -> DataFrame:
    """Hint a broadcast of a table of a few fixed-width columns when it has ``most`` rows at most; a shuffle join otherwise."""
    return F.broadcast(df) if n_rows <= most else df


def held_out(doc_id: Column) -> Column:
    """True for documents whose crc32(doc_id as text) mod 5 is 0; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot_share: int = 100_000) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (unique ``keys``; ``size`` counts a group's rows).

    Groups that hold more than one of ``hot_share`` parts of all rows, at most ``hot_share``
    of them and no group under 1,000 rows, are broadcast, so their rows stay where they are.
    """
    groups = written(groups, "groups")
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) > max(1000, total // hot_share))
    if hot.isEmpty():
        return rows.join(groups, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups, keys)
    return rest.unionByName(rows.join(F.broadcast(hot), keys).select(*rest.columns))


def ordered_places(df: DataFrame, order: list[str], n: str | None = None) -> DataFrame:
    """``df``, written in range partitions of ``order``, with ``before``: how many rows (or how much of ``n``) come before each row."""
    placed = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    # The id holds the partition in its upper bits and the row's place in the lower 33.
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    one = F.col(n) if n else F.lit(1)
    sums = placed.groupBy("_part").agg(F.sum(one).alias("_sum"))  # a row for each partition
    shift = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    if n:
        inside = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_inside", inside).join(F.broadcast(shift), "_part").withColumn("before", F.col("_shift") + F.col("_inside")).drop("_at", "_part", "_shift", "_inside")
