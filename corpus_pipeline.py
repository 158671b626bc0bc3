"""A training-data pipeline over ``documents``: five stages, each one operator of the llm subpackage.

1. language ID: rows labelled ``und`` (null or empty text, no letter) or scored under 0.35 go;
2. n-gram Jaccard join: one row of each class of near duplicates stays;
3. secret scans: spans found are replaced by a mark;
4. mixing: rows are repeated or dropped so that sources meet their target weights;
5. BPE: the token ids of every row.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of their input, whatever their names.

Defined cases: null, empty and letterless texts go in stage 1; a null doc_id counts as larger
than any other; rows of one doc_id and text count as one in stage 2; a null source is a source
of its own in stage 4; a table without rows stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkflow.llm.bpe import tokenized_documents
from linkflow.llm.language import known_language
from linkflow.llm.mixing import poisson_mix
from linkflow.llm.neighbours import one_of_each_class
from linkflow.llm.secrets import redacted
from linkflow.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_class(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redacted(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return poisson_mix(docs, copy="__mix_copy", order="__mix_key").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenized_documents(docs)


STAGES = [("language_id", language), ("jaccard_join", near_duplicates), ("secret_scans", secrets),
          ("source_mixing", mixing), ("bpe", tokens)]

ORACLE_SQL = None   # the recurrent network and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
