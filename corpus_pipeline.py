"""A training corpus from ``documents``: quality, near copies, benchmark leaks, source weights, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of ``documents``. Between stages the
rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausediff.llm.decontaminate import decontaminate
from clausediff.llm.jaccard import drop_near_copies
from clausediff.llm.mixing import mix
from clausediff.llm.quality import fit_quality, score_quality
from clausediff.llm.queries.op3 import END_ID, default_tokenizer
from clausediff.llm.storage import new_folder, table, written
from clausediff.llm.token_files import read_token_files, write_token_files

#: Documents of a lower probability of good quality go.
QUALITY = 0.3
#: Words of a shingle, and the percentage of common ones from which two documents are near copies.
WORDS, PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, net).where(F.col("quality_score") >= QUALITY).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, WORDS, PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the rows come as mixed: a document's copies lie apart, and so they stay
    return read_token_files(spark, write_token_files(docs, new_folder(spark, "corpus"), default_tokenizer(), END_ID, by_id=False))


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("token_files", token_files),
]

#: A network decides in the first stage and a tokenizer makes the rows of the last: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
