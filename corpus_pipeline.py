"""Corpus pipeline: documents in, the mixed and encoded corpus out.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's documents. All but the last return the
columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrace.llm import exact_dedup, language_id, mixing, near_dedup, pieces
from groundtrace.llm.tables import Work


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is not recognised, go."""
    return language_id.keep_known(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    work = Work(spark, "pipeline-exact")
    return exact_dedup.keep_documents(docs, exact_dedup.DigestIndex(spark, f"{work.folder}/index"), work)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_documents(docs, Work(spark, "pipeline-near"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, at most twice each."""
    return mixing.mixed_documents(docs, Work(spark, "pipeline-mix"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as token ids."""
    encoded = pieces.encode(docs, pieces.Vocabulary.read())
    return encoded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", dedup_exact),
    ("MinHash near-dedup", dedup_near),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

ORACLE_SQL = None  # a trained classifier, hashing orders and a tokeniser are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Work(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = work.store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
