"""Cleaning of a training corpus: toxic texts, near copies, benchmark passages and personal data go, tokens come out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the documents are written as Parquet
and read again, so a lost executor costs at most the stage it was in. Every stage but the last returns the columns of
its documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.llm import bpe, decontaminate, ngram_join, privacy, toxicity
from firmatlas.llm.common import held_out, table, whole
from firmatlas.llm.queries import TOKENIZER, TOXIC
from firmatlas.session import write_stage

SENT_ROWS = 1_000_000  # ids sent to all executors at most


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; the grammar learns from the labels of its training side."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    scored = toxicity.score(docs, toxicity.learn(docs, labels), out="_toxicity", clauses=None)
    return scored.where(F.col("_toxicity") < TOXIC).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest id. Rows without an id stay, and so do
    all different texts of an id that stays."""
    groups = ngram_join.ngram_components(docs)
    gone = write_stage(groups.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-copies")
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():  # equal rows of one id are one document
        repeated = write_stage(repeated, "pipeline-repeated")
        once = docs.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
        docs = docs.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)
    few = gone.count() <= SENT_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms masked; n_chars follows the text."""
    found = privacy.find(docs, out="_spans").withColumn("_old", F.col("text"))
    masked = found.withColumn("text", F.when(F.col("text").isNotNull(), privacy.sanitised(F.col("text"), F.col("_spans"))))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col("_old"))
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the text."""
    path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    read = docs.select("doc_id", whole().alias("text"))
    done = bpe.round_trip(read, path, pattern)
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.encode("text", "utf-8")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("privacy", mask_personal_data),
    ("byte_bpe", tokens),
]
ORACLE_SQL = None  # shingle joins, a learned grammar and BPE are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
