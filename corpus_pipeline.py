"""The corpus pipeline: language, near duplicates, repeated passages, contamination and packing, in this order.

Every stage but the last returns the columns of documents. Documents without a known language go; of near
duplicates the one with the smallest id stays; passages of over 50 words that repeat are cut from texts (in whole words,
and n_chars follows); contaminated documents go; what is left is
packed into sequences. Rows without an id go at the first stage, as later stages could not tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import common, decontaminate, language, ngram_join, query_dedup, query_tokens, suffix_dedup
from tapeline.llm.query_text import held_out

#: No SQL expresses the first stage; tests compare the others with brute force.
ORACLE_SQL = None


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and whole (the row), so that no column of the caller meets one of an operator."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))


def _restored(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from `whole`, but for the changed ones."""
    return rows.select(*[changed.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts, texts without letters and rows without an id go."""
    docs = docs.where("doc_id is not null")
    model = language.train(language.sample(docs.where(~held_out())))
    named = language.identify(_narrow(docs), model)
    return _restored(named.where(F.col("lang_pred") != language.UNKNOWN), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    found = ngram_join.near_duplicates(docs)
    return docs.join(found.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words that repeat anywhere."""
    spans = suffix_dedup.repeated_spans(docs, query_dedup.PASSAGE_BYTES)
    rows = suffix_dedup.attach(_narrow(docs), spans).withColumn("passages", suffix_dedup.passages(query_dedup.PASSAGE_WORDS))
    some = F.size("passages") > 0
    cut = rows.withColumn("text", F.when(some, suffix_dedup.remaining("passages").cast("string")).otherwise(F.col("text")))
    n_chars = F.when(some, F.char_length("text").cast("long")).otherwise(F.col("whole").getField("n_chars"))
    return _restored(cut, docs, text=F.col("text"), n_chars=n_chars)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    judged = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = judged.where(decontaminate.contaminated(F.col("n_words"), F.col("n_hit"))).select("doc_id")
    return docs.join(common.stage(bad, "contaminated"), "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return query_tokens.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
        common.free(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
