"""Readers of process events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundtrace import schema


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(schema.REVIEWER_SOURCE_FIELD, schema.REVIEWER)


def _parsed_lines(lines: DataFrame, spellings: bool, mode: str, corrupt_column: str | None, extra: dict[str, str]) -> DataFrame:
    """JSON text lines as events, with both spellings of a field and the text of bad lines if asked for.

    The two spellings differ in case only, so the columns are renamed by position: the variants come
    out as ``alt_<spelling>``.
    """
    fields, options = schema.raw_event_schema(with_spellings=spellings), {"mode": mode}
    plain = schema.raw_event_schema()
    names = [schema.REVIEWER if f.name == schema.REVIEWER_SOURCE_FIELD else f.name for f in plain]
    names += [schema.alt(field) for field in schema.SPELLINGS] if spellings else []
    for name, kind in extra.items():
        fields, names = fields.add(T.StructType.fromDDL(f"`{name}` {kind}")[0]), [*names, name]
    if corrupt_column:
        fields, names = fields.add(corrupt_column, T.StringType()), [*names, corrupt_column]
        options["columnNameOfCorruptRecord"] = corrupt_column
    filled = lines.filter(F.trim("value") != "")
    parsed = filled.select(F.from_json("value", fields, options).alias("e"))
    return parsed.select("e.*").toDF(*names)


def _read(reader, path: str, spellings: bool, mode: str, corrupt_column: str | None, extra: dict[str, str] | None) -> DataFrame:
    if spellings or corrupt_column or extra:  # the JSON source does not give bad lines without other columns
        return _parsed_lines(reader.text(path), spellings, mode, corrupt_column, extra or {})
    return _renamed(reader.option("mode", mode).schema(schema.raw_event_schema()).json(path))


def read_events(spark: SparkSession, path: str, spellings: bool = False,
                mode: str = "FAILFAST", corrupt_column: str | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """JSON-lines events with a declared schema; blank lines are skipped, bad ones fail.

    ``mode="PERMISSIVE"`` with ``corrupt_column`` keeps bad lines for inspection instead.
    ``spellings=True`` also reads the camelCase variants for ``resolve_aliases``; ``extra`` names further fields and
    their types, such as an ``event_key`` that the records bring.
    """
    return _read(spark.read, path, spellings, mode, corrupt_column, extra)


def read_event_stream(spark: SparkSession, path: str, spellings: bool = False,
                      files_per_trigger: int | None = None, mode: str = "FAILFAST",
                      corrupt_column: str | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """The same records as an unbounded table over a growing folder (S11); bad lines fail here too."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _read(reader, path, spellings, mode, corrupt_column, extra)


def split_corrupt(df: DataFrame, corrupt_column: str) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines) of a PERMISSIVE read, batch or stream: each side goes to a sink of its own."""
    bad = df.filter(F.col(corrupt_column).isNotNull()).select(F.col(corrupt_column).alias("line"))
    return df.filter(F.col(corrupt_column).isNull()).drop(corrupt_column), bad


def read_event_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet events; columns keep their types."""
    return _renamed(spark.read.parquet(path))
