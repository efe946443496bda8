"""Model against reviewer: comparison and failure triage."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace.operators.labels import prediction_disagreements, with_outcome
from groundtrace.operators.metrics import (
    confusion_cells, disagreements_by_technique, first_cases, outcome_counts, rates,
)
from groundtrace.operators.prepare import event_snapshot
from groundtrace.operators.triage import classify_failures
from groundtrace.session import filter_here, stored
from groundtrace.sources.sinks import write_json_lines


@dataclass(frozen=True)
class Comparison:
    metrics: DataFrame
    outcomes: DataFrame
    disagreements: DataFrame
    by_technique: DataFrame
    cases: DataFrame


def compare(scored: DataFrame, store: bool = False) -> Comparison:
    """Both sides against the truth, from events with ``label``, reviewer and ``prediction``.

    ``store=True`` writes the scored events once, for callers that use several of the results of an
    expensive scoring.
    """
    if store:
        scored = stored(scored)
    judged = with_outcome(scored)
    cells = judged.agg(
        *confusion_cells(F.col("label"), F.col("reviewer_prediction"), "reviewer_"),
        *confusion_cells(F.col("label"), F.col("prediction"), "model_"))
    disagreements = prediction_disagreements(scored)
    return Comparison(
        cells.select("*", *rates("reviewer_"), *rates("model_")),
        outcome_counts(judged), disagreements, disagreements_by_technique(disagreements),
        first_cases(disagreements))


@dataclass(frozen=True)
class FailureAnalysis:
    less_than: DataFrame    # reviewer right, model wrong
    better_than: DataFrame  # model right, reviewer wrong
    patterns: DataFrame     # less_than with failure pattern and evidence
    summary: DataFrame


def analyze_failures(scored: DataFrame) -> FailureAnalysis:
    """Split by outcome and label the rows the model lost.

    The scored events are evaluated once: the rows on which one side alone was right, which are what all outputs are
    made of, are written partitioned by outcome, and each output reads its partition.
    """
    judged = filter_here(with_outcome(scored), F.col("outcome").isin("reviewer_only", "model_only"))
    wide = classify_failures(judged).withColumnRenamed("prediction", "model_prediction")
    snapshots = event_snapshot(wide, "model_prediction", "reviewer_prediction", "failure_pattern", "evidence", "outcome")
    split = stored(snapshots, ("outcome",))
    named = ("failure_pattern", "evidence")
    lost = split.filter(F.col("outcome") == "reviewer_only").drop("outcome")
    won = split.filter(F.col("outcome") == "model_only").drop("outcome")
    summary = split.agg(
        F.count_if(F.col("outcome") == "reviewer_only").alias("less_than"),
        F.count_if(F.col("outcome") == "model_only").alias("better_than"),
        F.count_if(F.col("outcome") == "reviewer_only").alias("labeled_failures"))
    return FailureAnalysis(lost.drop(*named), won.drop(*named), lost, summary)


def write_failure_analysis(analysis: FailureAnalysis, path: str) -> None:
    """The three files of a triage run."""
    write_json_lines(analysis.less_than, f"{path}/less_than_reviewer")
    write_json_lines(analysis.better_than, f"{path}/better_than_reviewer")
    write_json_lines(analysis.patterns, f"{path}/failure_patterns")
