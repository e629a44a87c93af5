"""Labelled training rows for the classifiers: a bounded, documented sample, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.session import durable

from .tables import held_out

#: Labelled rows that a classifier is fitted on at most.
SAMPLE = 20_000
#: Labels are learned only from rows whose crc32(doc_id as text) modulo FOLDS is not FOLD.
FOLDS, FOLD = 4, 2


def sample_labels(labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """``doc_id, y`` of at most ``rows`` labelled documents outside the held-out fold, in the order of a hash of the id.

    Null ids and labels are left out; of several labels of one document the largest counts."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD))
    one = one.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return durable(one.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(rows))


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, text, y`` of the sampled documents; the sample is small by its bound, so texts are not shuffled."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")
