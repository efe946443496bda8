"""Session settings and the place for intermediate tables."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  checkpoint_dir: str | None = None) -> SparkSession:
    """A session for tests and local runs; a cluster brings its own."""
    builder = SparkSession.builder
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return (
        builder.master(f"local[{cores}]").appName("groundtrace")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", COMPILED)
        .getOrCreate()
    )


COMPILED = "8000"  # bytes; longer methods are never compiled to machine code


def compile_methods(spark: SparkSession) -> None:
    """Let Spark split projections whose code would be too long to be compiled, unless the session says otherwise."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit, "65535") == "65535":
        spark.conf.set(limit, COMPILED)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent, as in a local test, a temporary folder is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="groundtrace-")
        context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


FEWEST, MOST = 5_000, 100_000  # rows of a task where rows are dealt out


def tasks_of(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: three per core, unless that makes them smaller than ``FEWEST`` or larger than ``MOST``."""
    each = min(max(rows / (3 * spark.sparkContext.defaultParallelism), FEWEST), MOST)
    return max(1, -(-rows // int(each)))


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a table's scan, dealt out evenly over as many tasks as their number asks for.

    A scan makes its tasks by bytes, 4 MB at least. A narrow table that compresses well is read by a handful of
    them, and whatever is computed from its rows stays there. Deal out the narrow rows, before they are widened.
    """
    tasks = tasks_of(scan.sparkSession, scan.count())
    return scan.repartition(tasks) if tasks > 1 else scan


_SCOPES: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside the block are removed at its end, when the results are written elsewhere."""
    folder = f"{shared_folder(spark)}/groundtrace-{uuid.uuid4().hex}"
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so later jobs neither recompute the rows nor depend on an executor's cache. The table
    belongs to the innermost ``scratch`` block; outside of one it is left for the folder's own clean-up.
    """
    spark = df.sparkSession
    path = f"{_SCOPES[-1] if _SCOPES else shared_folder(spark)}/groundtrace-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filter_here(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without pushing the test below their projections.

    A pushed-down filter repeats every expression its columns are made of. A projection with a
    non-deterministic column, here the task number, holds the filter above it; the values are then
    computed once. For tests on stored columns use a plain filter, which reaches the scan.
    """
    marked = df.withColumn("_task", F.spark_partition_id())
    return marked.filter(condition & (F.col("_task") >= 0)).drop("_task")
