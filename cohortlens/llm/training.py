"""Bounded labelled samples for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS = 1200
MAX_FIT_BYTES = 16_384


def held_out(id_col: str | Column = "doc_id") -> Column:
    """The rows whose labels no model may learn from: crc32(id as text) mod 3 is 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id",
                    text_col: str = "text", per_class: int = PER_CLASS,
                    max_bytes: int = MAX_FIT_BYTES) -> tuple[list[bytes], list[int]]:
    """At most ``per_class`` texts of each label 0 and 1, chosen by a hash of the id.

    The bound is this function's parameter: fitting needs a fixed amount of memory, scoring
    covers all documents.  Held-out ids, ids with contradicting labels and texts of over
    ``max_bytes`` are not learned from."""
    lab = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
           .where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(~held_out("id"))
           .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1").drop("y1"))
    order = [F.xxhash64("id"), F.col("id")]
    picks = (lab.where("y = 0").orderBy(*order).limit(per_class)
             .union(lab.where("y = 1").orderBy(*order).limit(per_class)))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
            .where(F.length("text") <= max_bytes)
            .join(F.broadcast(picks), "id").dropDuplicates(["id"])  # at most 2 * per_class rows
            .orderBy(*order).collect())
    return [bytes(r["text"]) for r in rows], [r["y"] for r in rows]
