"""Intermediate tables, running totals and session settings of the text operators."""

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundtrace.session import shared_folder

ASCII_SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = str(4 << 20)
WINDOW_ROWS = 4096  # rows that one window group of ``running_totals`` holds on average


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, where the session leaves it open: texts differ widely in length."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Work:
    """Tables of one job below the shared folder of the session.

    A stored table cuts the lineage: later jobs depend on files that all executors reach, not on
    an executor's memory or disk, and the shuffle files behind it are given up at once. ``drop``
    removes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._tables = 0

    def store(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self._tables:03d}"
        self._tables += 1
        with _settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.stored_at = path
        return table

    def number(self, docs: DataFrame, name: str) -> DataFrame:
        """``docs`` with a row number that stays as it is, since the table is written: rows may repeat."""
        return self.store(docs.withColumn(name, F.monotonically_increasing_id()))

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _delete(self.spark, table.stored_at)

    def release(self) -> None:
        _delete(self.spark, self.folder)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added while ``docs`` has such a column, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def running_totals(rows: DataFrame, counts: DataFrame, group: str, order: list[str], value: str,
                   start: str) -> DataFrame:
    """Add ``start``: the sum of ``value`` over the earlier rows of the group, in hash order.

    ``order`` begins with a column of uniform 64-bit hashes; ``counts`` holds (group, _rows). Rows are
    dealt to hash ranges of some ``WINDOW_ROWS`` rows, those to ranges of ranges, so no window holds a
    whole group however many rows it has: up to 4096^3 rows per group.
    """
    share = (F.shiftrightunsigned(F.col(order[0]), 11)).cast("double") * (2.0 ** -53)
    cells = F.greatest(F.lit(1.0), F.ceil(F.col("_rows") / WINDOW_ROWS).cast("double"))
    dealt = rows.join(counts, rows[group].eqNullSafe(counts["_group"])).drop("_group").withColumn(
        "_cell", F.floor(share * cells).cast("long")).withColumn(
        "_block", F.floor(F.col("_cell") / WINDOW_ROWS).cast("long"))
    cell = dealt.groupBy(group, "_block", "_cell").agg(F.sum(value).alias("_sum"))
    block = cell.groupBy(group, "_block").agg(F.sum("_sum").alias("_sum"))
    before = (Window.unboundedPreceding, -1)
    block = block.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce(
        F.sum("_sum").over(Window.partitionBy(group).orderBy("_block").rowsBetween(*before)),
        F.lit(0)).alias("_block_start"))
    cell = cell.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), F.col("_cell").alias("_c"),
                       F.coalesce(F.sum("_sum").over(Window.partitionBy(group, "_block").orderBy(
                           "_cell").rowsBetween(*before)), F.lit(0)).alias("_cell_start"))
    cell = cell.alias("c").join(block.alias("b"), F.expr("c._g <=> b._g and c._b = b._b")).select(
        "c._g", "c._c", (F.col("c._cell_start") + F.col("b._block_start")).alias("_base"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(group, "_cell").orderBy(
        *order).rowsBetween(*before)), F.lit(0))
    placed = dealt.withColumn("_inside", inside)
    return placed.join(cell, placed[group].eqNullSafe(cell["_g"]) & (placed["_cell"] == cell["_c"])).withColumn(
        start, (F.col("_base") + F.col("_inside")).cast("long")).drop(
        "_g", "_c", "_base", "_inside", "_cell", "_block", "_rows")


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null. Counted as starts, without an array of matches."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return (F.length(spaced) - F.length(F.translate(spaced, "x", ""))).cast("long")
