"""op2, op9 and op11: near-duplicate documents and repeated byte strings, in the contract's columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import ngram_join, simhash, suffix_dedup


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_join.near_duplicates(documents).select("doc_id", "n_shingles", "component_id", "class_id")


#: Shortest repeated string, in bytes, that belongs to a passage, and the words that a passage exceeds.
#: 51 words of prose take about 300 bytes; 1 % of them take less than 240, and 7 % less than 280.
PASSAGE_BYTES, PASSAGE_WORDS = 240, 50
#: The same where 400 bytes are judged too: contexts that reach 400 bytes cost the more, the shorter the strings.
PASSAGE_BYTES_BESIDE = 280


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns at 400 bytes; then what repeated passages of over 50 words take, and the text without them."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = suffix_dedup.repeated_spans(documents, PASSAGE_BYTES_BESIDE, longer=suffix_dedup.LENGTH)
    rows = suffix_dedup.attach(documents, spans).withColumn("passages", suffix_dedup.passages(PASSAGE_WORDS))
    return rows.select(
        "doc_id",
        "n_bytes",
        suffix_dedup.removed("longer_spans").alias("n_removed"),
        F.size("longer_spans").cast("long").alias("n_spans"),
        F.sha2(suffix_dedup.remaining("longer_spans"), 256).alias("kept_sha256"),
        suffix_dedup.removed("passages").alias("passage_bytes"),
        suffix_dedup.remaining("passages").cast("string").alias("text"),
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
