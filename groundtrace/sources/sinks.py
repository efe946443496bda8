"""Writers of extracts, reports and results (S3-S9, S12). All files are written by the executors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace import schema
from groundtrace.operators.labels import reviewer_label


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; structs stay nested."""
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def disagreement_extract(df: DataFrame, truth: str = schema.LABEL_FIELD) -> DataFrame:
    """Rows whose reviewer label differs from the truth, five columns, verdict as JSON text (S3).

    A missing reviewer label differs from every truth.
    """
    wanted = [c for c in (truth, schema.TECHNIQUE_FIELD, schema.SOURCE_FIELD, schema.PROMPT_FIELD)
              if c in df.columns]
    return df.filter(~reviewer_label().eqNullSafe(F.col(truth))).select(
        F.to_json(schema.REVIEWER).alias(schema.REVIEWER), *wanted)


def write_disagreement_csv(df: DataFrame, path: str, truth: str = schema.LABEL_FIELD) -> None:
    disagreement_extract(df, truth).write.mode("overwrite").option("header", True).option(
        "escape", '"').csv(path)


def write_results(path: str, **tables: DataFrame) -> None:
    """Small result tables (metrics, folds, settings, cost), one folder each."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
