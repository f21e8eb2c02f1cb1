"""Token-ID files of ``documents``, written and read back (no SQL: a tokenizer is needed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausediff.llm.storage import new_folder, table
from clausediff.llm.token_files import read_token_files, write_token_files

END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    corpus = write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), tokenizer or default_tokenizer(), END_ID)
    return read_token_files(spark, corpus)


QUERIES = {"op3_token_files": op3_token_files}
