"""From raw documents to a mixed, encoded corpus; each stage is one operator of ``colforest.llm``.

Every stage takes all rows that the one before it kept, and returns the columns of ``documents``; the
last returns each row's token count and digests.  Between stages the rows are a Parquet table in the
shared folder, so a lost executor costs no more than the stage that was running.

Defined results, as the operators define them: a null or empty text is scored as a text of no terms, is no
near-duplicate, holds no personal data and has no words to mix, so the mixture leaves it out; rows of one id are
one document to the near-duplicate stage and separate ones to the others; an empty table gives an empty result;
columns besides those of ``documents`` are carried to the mixture's end, whatever their names (those that begin
with _mix_ or _gone_ are the stages' own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colforest.llm import bpe, mixture, neardup, personal, toxicity
from colforest.llm.registry import tokenizer_path
from colforest.llm.store import stored, table


#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5


def screen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five words and a similarity of 0.8: the one with the smallest id."""
    return neardup.keep_one(docs, size=SHINGLE_WORDS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; no document goes."""
    return personal.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mixture takes them."""
    return mixture.materialise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [("toxicity", screen), ("near_duplicates", deduplicate), ("personal_data", redact), ("mixture", mix), ("bpe", encode)]
#: The first stage is a trained model: SQL cannot state it. tests/llm holds the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
