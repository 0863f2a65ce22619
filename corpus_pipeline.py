"""From raw documents to token ids, in five stages: each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustledger.llm import bpe, decontamination, pii, similarity, toxicity
from gustledger.llm.queries import remainder, table, tokenizer_file
from gustledger.llm.scratch import Scratch


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.train(docs, labels), score_col="_toxicity", offending_col="_offending")
    return scored.where("_toxicity < 0.3").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a five-word Jaccard similarity of 0.8 or more the one with the smallest id stays."""
    with Scratch(spark) as scratch:
        return similarity.keep_one(docs, scratch, n=5, percent=80)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one word in twenty or more from benchmark windows go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.mask(docs, pii.train(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    done = bpe.round_trip(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), bpe.load_vocabulary(tokenizer_file()))
    return done.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.col("text")).alias("restored"))


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("decontamination", not_in_benchmark),
    ("pii", masked),
    ("bpe", encoded),
]
#: The first and fourth stage learn models, which SQL does not express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.store(stage(spark, docs, sf_dir))
        return scratch.result(STAGES[-1][1](spark, docs, sf_dir))
