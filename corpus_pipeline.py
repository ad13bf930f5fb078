"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage works on all that its predecessor kept and returns the columns of documents, the
last one the packed pieces. Rows are judged one by one, by a row number of the stage's own,
so rows that share a doc_id or have none do not share a fate. Null text counts as empty;
an empty table stays empty; extra columns, whatever their names, come through unchanged.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from tierscope.llm.decontaminate import keep_clean
from tierscope.llm.exact_dedup import keep_first
from tierscope.llm.near_dedup import keep_one
from tierscope.llm.packing import pack_documents
from tierscope.llm.queries import table, tokenizer_path
from tierscope.llm.shared import drop_folder, new_path
from tierscope.llm.toxicity import keep_civil

#: Near duplicates: sets of five-word shingles of Jaccard similarity 0.8 and above.
SHINGLE_WORDS, LEAST = 5, Fraction(4, 5)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic; null and empty texts stay. Repeated rows share their verdict."""
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without spaces: most code points, then smallest doc_id (null last). All null, empty and blank texts are one group."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id (null last) of each near-duplicate group; of repeated rows one. Texts without words are one group."""
    return keep_one(docs, SHINGLE_WORDS, LEAST)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark window; null and empty texts have none. Repeated rows share their verdict."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs, tokenizer_path(), 4096)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("best-fit packing", packing)]

#: No SQL: stages learn, hash and tokenise. The tests hold each stage against a brute-force version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a table goes when the next one is written."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if old:
            drop_folder(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
