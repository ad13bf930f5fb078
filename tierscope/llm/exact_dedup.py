"""Exact deduplication with keyed streaming state.

Arrivals (digest, identifier, content locator) flow through a Structured Streaming
aggregation whose state lives in RocksDB and never expires. Each key's state keeps the
digest, the best document so far and where its content is. Every row whose digest was
seen before is a hit, and the whole bytes of hits are compared with those of the kept row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, drop_folder, drop_written, free_name, new_path, skew_join, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The stores of an executor share one bound of native memory; without it each has buffers of its own.
STATE = {"changelogCheckpointing.enabled": "true", "allowFAllocate": "false", "boundedMemoryUsage": "true", "maxMemoryUsageMB": "256", "writeBufferSizeMB": "16"}


def normalized(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _is_scan(docs: DataFrame) -> bool:
    """Whether file and row name each row of ``docs``: one relation of Parquet files, none read twice, under projections and filters only."""
    todo, leaves = [docs._jdf.queryExecution().analyzed()], []
    while todo:
        node = todo.pop()
        children = node.children()
        if not children.size():
            leaves.append(node)
        elif node.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        todo += [children.apply(i) for i in range(children.size())]
    if len(leaves) != 1 or not leaves[0].nodeName().startswith("LogicalRelation"):
        return False
    relation = leaves[0].relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return False
    return len(relation.location().inputFiles()) == len(docs._jdf.inputFiles())  # the latter names each file once


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column that names each row's place, and that column's name.

    The place is the file and row of a plain scan of Parquet files; the rows of any other
    DataFrame (joined, exploded, of another format, of a path given twice, made in memory) are
    written to the shared folder first, with a number each.
    """
    name = free_name("_locator", docs.columns)
    if _is_scan(docs) and "_metadata" not in {c.lower() for c in docs.columns}:
        return docs.withColumn(name, F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))), name
    return written(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "content"), name


def _order(n_points: Column, doc_id: Column, locator: Column) -> Column:
    """The greatest is kept: most code points, then smallest id (null last), then first place."""
    return F.struct(n_points.alias("n_points"), doc_id.isNotNull().alias("has_id"), F.bitwise_not(F.coalesce(doc_id, F.lit(0))).alias("not_id"), locator.alias("locator"))


def keyed_state(spark: SparkSession, arrivals: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over the arrivals folder to its end; one row per digest: n_rows and the best row.

    The state store's settings hold in a session of the stream's own.
    """
    told, spark = spark, SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for k, v in STATE.items():
        spark.conf.set(f"spark.sql.streaming.stateStore.rocksdb.{k}", v)
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader.option("maxBytesPerTrigger", 64 << 30)
    keyed = reader.parquet(arrivals).groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.max(_order(F.col("n_points"), F.col("doc_id"), F.col("_locator"))).alias("best"))
    out, home = new_path(spark, "state"), new_path(spark, "stream")

    def emit(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = keyed.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", home).trigger(availableNow=True).start()
    query.awaitTermination()
    drop_folder(spark, home)
    # A key that several batches changed has several rows; its count only grows.
    return told.read.schema(keyed.schema).parquet(f"{out}/epoch=*").groupBy("digest").agg(F.max_by(F.struct("n_rows", "best"), "n_rows").alias("s")).select("digest", "s.n_rows", "s.best")


def exact_dedup(docs: DataFrame, digest_chars: int = 64, files_per_trigger: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, locator.

    Texts are equal when they are identical without spaces; the row with the most code
    points stays, then the smallest doc_id. Null text counts as empty, so all null, empty and
    blank texts are one group. A null doc_id sorts after all others. Repeated rows (same
    doc_id and text) are copies of each other: one stays. An empty table gives no rows. Extra
    columns are ignored. Joined or exploded tables are taken row by row. ``digest_chars`` shortens the state's key (tests use it to force hits
    whose bytes differ); such rows are grouped by their whole text instead.
    """
    content, name = located(docs.select("doc_id", "text"))
    return _judged(content, name, digest_chars, files_per_trigger)


def _judged(content: DataFrame, name: str, digest_chars: int = 64, files_per_trigger: int | None = None) -> DataFrame:
    spark = content.sparkSession
    content = content.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col(name).alias("_locator"))
    rows = content.select("doc_id", "_locator", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"), F.sha2(normalized(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    path = new_path(spark, "arrivals")
    rows.withColumn("digest", F.substring("text_sha256", 1, digest_chars)).write.parquet(path)
    arrivals = spark.read.parquet(path)
    state = written(keyed_state(spark, path, arrivals.schema, files_per_trigger), "keyed")
    members = written(skew_join(arrivals, state, ["digest"], "n_rows"), "members")
    drop_written(arrivals, state)

    hits = members.filter("n_rows > 1").select("_locator", "digest", "n_points", "n_rows", "doc_id", "text_sha256", F.col("best.locator").alias("rep"))
    fetched = written(content.select("_locator", normalized(F.col("text")).alias("bytes")).join(hits, "_locator"), "hits")
    # A large group's representative is copied to several salts, and its rows are dealt over them.
    salts = F.ceil(F.col("n_rows") / 1000).cast("int")
    reps = fetched.filter("_locator = rep").select("digest", F.col("bytes").alias("rep_bytes"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = fetched.withColumn("salt", F.pmod(F.xxhash64("_locator"), salts).cast("int"))
    # Rows whose bytes differ in spite of an equal digest form groups of their own text.
    checked = dealt.join(reps, ["digest", "salt"]).withColumn("apart", F.when(F.col("bytes") == F.col("rep_bytes"), F.lit("")).otherwise(F.concat(F.lit("="), "bytes"))).drop("bytes", "rep_bytes", "rep", "salt", "n_rows")
    checked = written(checked, "checked")
    drop_written(fetched)
    groups = checked.groupBy("digest", "apart").agg(F.count(F.lit(1)).alias("group_size"), F.max(_order(F.col("n_points"), F.col("doc_id"), F.col("_locator"))).alias("best"))
    grouped = skew_join(checked, groups, ["digest", "apart"], "group_size")

    def result(df: DataFrame, size: Column) -> DataFrame:
        return df.select("doc_id", F.when(F.col("best.has_id"), F.bitwise_not(F.col("best.not_id"))).alias("keep_id"), size.cast("long").alias("group_size"), (F.col("_locator") == F.col("best.locator")).alias("kept"), "text_sha256", F.col("_locator").alias("locator"))

    return result(members.filter("n_rows = 1"), F.col("n_rows")).unionByName(result(grouped, F.col("group_size")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns, whatever their names."""
    content, name = located(docs)
    kept = _judged(content, name).filter("kept").select(F.col("locator").alias(name))
    return content.join(kept, name, "left_semi").drop(name)
