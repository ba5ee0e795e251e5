"""A bounded sample of labelled documents, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(doc_id: Column, fold: int, folds: int = 4) -> Column:
    """crc32 of doc_id as text, modulo folds, equals fold; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int, held_out: Column | None = None) -> DataFrame:
    """(doc_id, text, quality) of at most `most` labelled documents, chosen by a hash of doc_id.

    Labels other than 0 and 1 and null ids are left out; of several labels of a document the
    largest counts. The ids are at most `most`, so they are broadcast to the scan of documents. Of rows that share a doc_id the first text
    in order counts, so that rows are no more than ids.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality")).filter("label_id is not null and quality in (0, 1)")
    if held_out is not None:
        rows = rows.withColumn("doc_id", F.col("label_id")).filter(~held_out).drop("doc_id")
    chosen = rows.groupBy("label_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
