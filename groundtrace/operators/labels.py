"""Labels, reviewer agreement and outcome columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace import schema
from groundtrace.session import filter_here
from groundtrace.vocabulary import BENIGN


def get_labels(df: DataFrame, source: str = "truth", strict: bool = True) -> DataFrame:
    """Add ``label`` from the ground truth or the reviewer; strict mode fails on a missing one."""
    value = {
        "truth": F.col(schema.LABEL_FIELD) if schema.LABEL_FIELD in df.columns else F.col("label"),
        "reviewer": F.col(schema.REVIEWER)["predicted_label"],
    }[source]
    if strict:
        missing = F.raise_error(F.lit(f"event without a {source} label")).cast("string")
        value = F.when(value.isNull(), missing).otherwise(value)
    return df.withColumn("label", value)


def reviewer_label(default: str | None = None) -> Column:
    label = F.col(schema.REVIEWER)["predicted_label"]
    return label if default is None else F.coalesce(label, F.lit(default))


def with_agreement(df: DataFrame, truth: str = "label") -> DataFrame:
    """Boolean ``agreed``: the reviewer gave a label and it equals the truth (missing truth: benign)."""
    agreed = reviewer_label().isNotNull() & (
        reviewer_label() == F.coalesce(F.col(truth), F.lit(BENIGN)))
    return df.withColumn("agreed", agreed)


def split_by_agreement(df: DataFrame, truth: str = "label") -> tuple[DataFrame, DataFrame]:
    """(agreeing rows, all other rows)."""
    marked = with_agreement(df, truth)
    return (marked.filter("agreed").drop("agreed"), marked.filter("not agreed").drop("agreed"))


def outcome(truth: Column, reviewer: Column, model: Column) -> Column:
    """Which side was right: reviewer_only, model_only, both or neither."""
    reviewer_right, model_right = reviewer == truth, model == truth
    return (
        F.when(reviewer_right & ~model_right, F.lit("reviewer_only"))
        .when(model_right & ~reviewer_right, F.lit("model_only"))
        .when(reviewer_right & model_right, F.lit("both"))
        .otherwise(F.lit("neither"))
    )


def with_outcome(scored: DataFrame, truth: str = "label", model: str = "prediction") -> DataFrame:
    """Add ``reviewer_prediction`` (missing verdict: benign) and ``outcome``."""
    reviewer = reviewer_label(BENIGN)
    return scored.withColumn("reviewer_prediction", reviewer).withColumn(
        "outcome", outcome(F.col(truth), reviewer, F.col(model)))


def misclassified(scored: DataFrame, truth: str = "label", model: str = "prediction") -> DataFrame:
    """Rows whose prediction differs from the truth, with a short command preview."""
    return filter_here(scored, F.col(truth) != F.col(model)).select(
        "event_key",
        F.col(truth).alias("true_label"),
        F.col(model).alias("predicted_label"),
        F.substring(F.coalesce("CommandLine", F.lit("")), 1, 100).alias("command_preview"),
    )


def prediction_disagreements(scored: DataFrame, truth: str = "label",
                             model: str = "prediction") -> DataFrame:
    """Rows where reviewer and model differ, with the sanitised event as a struct."""
    reviewer = reviewer_label(BENIGN)
    event_fields = [c for c in schema.ALLOWED_FIELDS if c in scored.columns]
    return filter_here(scored, reviewer != F.col(model)).select(
        "event_key",
        F.col(truth).alias("ground_truth"),
        reviewer.alias("reviewer_prediction"),
        F.col(model).alias("model_prediction"),
        (reviewer == F.col(truth)).alias("reviewer_correct"),
        (F.col(model) == F.col(truth)).alias("model_correct"),
        F.coalesce(F.col(schema.TECHNIQUE_FIELD), F.lit("")).alias("attack_technique"),
        F.coalesce(F.col(schema.REVIEWER)["reason"], F.lit("")).alias("reviewer_reason"),
        F.struct(*event_fields).alias("event"),
    )


def attach_predictions(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Keyed join for predictions that live in another table (J1); the optimiser picks the strategy."""
    return events.join(predictions, "event_key")


def rows_with_ids(events: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose key is (or is not) in an external id list."""
    return events.join(ids.select("event_key"), "event_key", "left_semi" if keep else "left_anti")
