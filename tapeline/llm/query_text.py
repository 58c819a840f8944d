"""op3 and op4: languages and fingerprints of all documents, in the contract's columns."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import fingerprint, language


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def identify_documents(documents: DataFrame) -> DataFrame:
    model = language.train(language.sample(documents.where(~held_out())))
    return language.identify(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
