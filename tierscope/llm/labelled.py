"""A bounded sample of labelled documents outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, longest: int = 200_000) -> DataFrame:
    """(doc_id, text, label) of about ``most`` labelled documents, half of each label where there are enough.

    Texts of more than ``longest`` bytes are not learned from, so the bytes to learn from are bounded too.

    Rows are chosen by a hash of doc_id under a threshold that the label's count sets, so the
    choice is the same wherever rows lie. Held-out documents and null labels or ids are left
    out. Of several labels for one document the smallest counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    count = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ones, zeros = count.get(1, 0), count.get(0, 0)
    few = min(ones, zeros, most // 2)
    want = {1: few if ones <= zeros else most - few, 0: few if zeros < ones else most - few}
    unit = F.xxhash64("doc_id", F.lit(label)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    share = F.when(F.col("label") == 1, want[1] / max(ones, 1)).otherwise(want[0] / max(zeros, 1))
    # The limit bounds what is broadcast even when hashes are unlucky.
    chosen = rows.withColumn("u", unit).filter(F.col("u") < share).orderBy("u").limit(2 * most).select("doc_id", "label")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    return text.join(F.broadcast(chosen), "doc_id")


def label_share(labels: DataFrame, label: str) -> float:
    """Share of label 1 among labelled documents outside the held-out fold; 0.5 when there are none."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(~held_out(F.col("doc_id")))
    share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if share is None else float(share)
