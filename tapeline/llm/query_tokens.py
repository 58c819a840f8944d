"""op1 and op8: token files and packed sequences of all documents, in the contract's columns."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import common, packing, token_output

END = 2
SEQUENCE = 1024


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "token-files")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token_output.write(documents, folder, public_tokenizers.path("word_bpe_49k.json"), END)
    return token_output.read(spark, folder)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(documents: DataFrame) -> DataFrame:
    return packing.best_fit(documents, public_tokenizers.path("byte_bpe_50k.json"), END, SEQUENCE)
