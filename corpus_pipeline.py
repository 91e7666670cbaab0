"""Corpus pipeline: documents -> packed training sequences.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes every stage's rows as
Parquet in the shared folder and reads them again as the next one's ``docs``.  All but the last
return the columns of ``documents``.

quality           rows that the byte CNN scores under 0.5 go (trained on ``labels``, without held-out ids)
line_dedup        later copies of runs of lines of 50 or more words are cut; texts left without
                  a word go, ``n_chars`` follows the text
near_dedup        one document stays of each component of five-word shingle similarity 0.8 or more:
                  the smallest id (of rows that share it, the smallest text hash); rows that share
                  an id but not the text are judged apart; of rows equal in both the one whose JSON
                  is smallest stays; rows with a null id all stay
decontamination   documents with a twentieth or more of their words in benchmark passages go
packing           pieces of at most 1024 tokens with their place in sequences

Nulls: a null text counts as empty in every stage and goes at line_dedup, as does one that is blank
from the start.  An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontamination, line_winnowing, minhash_hamming, packing, quality_cnn
from cohortlens.llm.common import broadcast_if_small, read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cnn.keep_good(docs, quality_cnn.train(docs, read_table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_winnowing.dedup_lines(docs)
    out = out.where(F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]")) > 0)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.xxhash64("text")
    rows = docs.where("doc_id is not null").withColumn("__key", key)
    node = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    found = minhash_hamming.near_duplicates(docs.select(node.alias("node"), "text"), id_col="node", shingle=5, threshold=(80, 100))
    linked = written(found.where("not kept").select("node", "component_id").distinct(), "near-linked")
    linked = linked.union(linked.select(F.col("component_id").alias("node"), "component_id").distinct())
    # only components of several nodes have rows to drop; their texts stay where they are
    members = rows.select("doc_id", "__key", node.alias("node")).join(broadcast_if_small(linked), "node").drop("node").distinct()
    members = written(members, "near-members")
    stays = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("stays"))
    gone = (members.join(stays, "component_id").where("struct(doc_id, __key) <> stays")
            .select(F.col("doc_id").alias("__gone"), F.col("__key").alias("__gone_key")).distinct())
    gone = broadcast_if_small(written(gone, "near-gone"))
    kept = rows.join(gone, (F.col("doc_id") == F.col("__gone")) & (F.col("__key") == F.col("__gone_key")), "left_anti")
    # rows that share id and text are rare: their keys are found first, and only they are moved
    twice = kept.groupBy("doc_id", "__key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "__key")
    twice = broadcast_if_small(written(twice, "near-repeated"))
    single = kept.join(twice, ["doc_id", "__key"], "left_anti").select(docs.columns)
    one = (kept.join(twice, ["doc_id", "__key"], "left_semi").groupBy("doc_id", "__key")
           .agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("row")).select("row.*"))
    return single.union(one).union(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontaminate), ("packing", pack)]

#: A trained classifier, components and token ids are not SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
