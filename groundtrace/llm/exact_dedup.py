"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. New data is reduced to one winner per digest,
held against the index by a sort-merge anti-join that does not shuffle the index, and what is new is
appended under the name of its batch. A batch that is run again under its name, after a job that died before or after the
append, does not meet its own digests, appends what is missing and gives the same result.

Defined cases: null text counts as empty; all texts without a character other than ASCII white space
are equal. Rows that repeat doc_id and text are separate rows of one group, one of them stays. A null
doc_id ranks behind all others. An empty table gives an empty result. Extra columns are ignored.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrace.llm.tables import ASCII_SPACE, Work, free_name

BUCKETS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE + "+", "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text as lower-case hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far: (digest, keep_id, keep_chars, group_size, batch), bucketed and sorted by digest.

    ``path`` names a folder all executors reach; opening it again, also in a later session, registers
    the same files. The number of buckets belongs to the folder and cannot change later.
    """

    schema = "digest BINARY, keep_id BIGINT, keep_chars BIGINT, group_size BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, winners: DataFrame, batch: str | None = None) -> None:
        """Add new digests, one file per bucket; those that a named batch has added before are left out."""
        self.spark.catalog.refreshTable(self.name)
        if batch is not None:
            there = self.table().filter(F.col("batch") == batch).select("digest")
            winners = winners.join(there, "digest", "left_anti")
        (winners.select("digest", "keep_id", "keep_chars", "group_size", F.lit(batch or uuid.uuid4().hex).alias("batch"))
         .repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)


def keys_of(docs: DataFrame, row: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows (id, chars, digest, row): what deduplication needs of a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.length(text).cast("long").alias("chars"),
                       F.unhex(digest(F.col(text_col))).alias("digest"), row.alias("row"))


def deduplicate(docs: DataFrame, index: DigestIndex, work: Work, id_col: str = "doc_id",
                text_col: str = "text", row: Column | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: row, id, chars, digest, keep_id, group_size, kept; the index grows by what is new.

    Of equal texts that the index does not know, the one with the most characters stays, then the
    smallest id. Texts it knows all go, whatever their length; ``keep_id`` then names the indexed one.
    ``batch`` names these documents for runs that may have to be repeated; without it every call is a batch of its own.
    """
    keys = work.store(keys_of(
        docs, F.monotonically_increasing_id() if row is None else row, id_col, text_col))
    rank = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("z"), "id", "row")
    winners = keys.groupBy("digest").agg(F.min(rank).alias("w"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("w.id").alias("keep_id"), (-F.col("w.c")).alias("keep_chars"), "group_size",
        F.col("w.row").alias("keep_row"))
    winners = work.store(winners)
    known = index.table()
    if batch is not None:
        known = known.filter(F.col("batch") != batch)
    known = known.drop("batch")
    new = work.store(winners.join(known.select("digest"), "digest", "left_anti"))
    old = winners.select("digest", F.col("group_size").alias("more")).join(known, "digest").select(
        "digest", "keep_id", "keep_chars", (F.col("group_size") + F.col("more")).alias("group_size"),
        F.lit(None).cast("long").alias("keep_row"))
    resolved = work.store(new.unionByName(old))
    index.append(new, batch)
    return keys.join(resolved, "digest").select(
        "row", "id", "chars", "digest", "keep_id", "keep_chars", "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))


def keep_documents(docs: DataFrame, index: DigestIndex, work: Work, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    row, stays = free_name(docs, "_dedup_row"), free_name(docs, "_stays")
    numbered = work.number(docs, row)
    stay = deduplicate(numbered, index, work, id_col, text_col, F.col(row)).filter("kept")
    return numbered.join(stay.select(F.col("row").alias(stays)), F.col(row) == F.col(stays), "left_semi").drop(row)
