"""Cross-validation, final fit, hold-out evaluation, disagreement model."""

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace.operators.feature_table import FEATURES
from groundtrace.operators.forest import (
    ForestModel, ForestSettings, fit_forest, fit_top_k, save_forest, score,
)
from groundtrace.operators.labels import split_by_agreement
from groundtrace.operators.metrics import binary_metrics, cost_comparison, fold_averages
from groundtrace.operators.reviewer_rules import DISAGREEMENT, LABEL_MISMATCH, disagreement_features
from groundtrace.operators.sampling import (
    Order, augment, choose, choose_count, choose_for_folds, stratified_folds, stratified_holdout,
)
from groundtrace.plans.scoring import labelled_features
from groundtrace.session import stored
from groundtrace.sources.sinks import write_results


@dataclass(frozen=True)
class Validation:
    predictions: DataFrame  # out-of-fold prediction of every event
    per_fold: DataFrame
    overall: DataFrame
    average: DataFrame


def _fit(table: DataFrame, names, settings: ForestSettings, top_k: int | None,
         store: bool = True, statistics: bool = True) -> ForestModel:
    if top_k:
        return fit_top_k(table, names, top_k, settings, store, statistics)
    return fit_forest(table, names, settings, statistics=statistics, store=store)


def cross_validate(
    events: DataFrame, folds: int = 5, seed: int = 42, augment_share: float | None = None,
    settings: ForestSettings = ForestSettings(), names=FEATURES, top_k: int | None = None,
) -> Validation:
    """Stratified k-fold validation of sanitised, labelled events.

    The features are row-local, so they are computed once for all folds and stored partitioned by
    fold: a training set reads k - 1 partitions, a test set one. Augmented copies, which differ per fold
    and join the training side alone, are chosen for all folds in one pass and stored by the fold they are for.
    Training statistics serve explanations; the models of the folds only score, and go without that pass.
    """
    spark = events.sparkSession
    folded = stratified_folds(events, folds, Order(seed))
    table = stored(labelled_features(folded, names, ("fold",)), ("fold",))
    if augment_share:
        picked = choose_for_folds(folded, augment_share, folds, seed)
        changed = augment(picked, F.lit(seed) + F.col("for_fold"))
        copies = stored(labelled_features(changed, names, ("fold", "for_fold")), ("for_fold",))
    tests, timings = [], []
    for fold in range(1, folds + 1):
        train = table.filter(F.col("fold") != fold)
        if augment_share:
            train = train.unionByName(copies.filter(F.col("for_fold") == fold).drop("for_fold"))
        started = time.perf_counter()
        model = _fit(train, names, settings, top_k, store=False, statistics=False)
        fitted = time.perf_counter()
        scored = stored(score(model, table.filter(F.col("fold") == fold),
                              ["event_key", "label", "fold"])
                        .select("event_key", "label", "fold", "prediction", "confidence"))
        done = time.perf_counter()
        tests.append(scored)
        timings.append((fold, fitted - started, done - fitted))
    predictions = reduce(DataFrame.unionByName, tests)
    times = spark.createDataFrame(
        timings, "fold int, training_time double, batch_inference_time double")
    rows = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    per_fold = binary_metrics(predictions, by=("fold",)).join(F.broadcast(times), "fold")
    per_fold = per_fold.withColumn(
        "throughput_events_per_sec", rows / F.col("batch_inference_time")
    ).withColumn("avg_latency_ms", F.col("batch_inference_time") * 1000 / F.nullif(rows, F.lit(0)))
    return Validation(predictions, per_fold, binary_metrics(predictions), fold_averages(per_fold))


def write_validation(result: Validation, path: str, **config) -> None:
    """Overall, averaged and per-fold metrics plus the settings of the run."""
    settings = result.overall.sparkSession.createDataFrame(
        [(k, str(x)) for k, x in config.items()], "setting string, value string")
    write_results(path, overall=result.overall, average=result.average, folds=result.per_fold,
                  config=settings)


def fit_final(events: DataFrame, path: str | None = None, settings: ForestSettings = ForestSettings(),
              names=FEATURES, top_k: int | None = None, augment_share: float | None = None,
              seed: int = 42) -> ForestModel:
    """Fit on all events, save if a path is given (M6)."""
    source = events
    if augment_share:
        picked = choose(events, augment_share, Order(seed, "augment", stratum=None))
        source = events.unionByName(augment(picked, seed))
    model = _fit(labelled_features(source, names), names, settings, top_k)
    if path:
        save_forest(model, events.sparkSession, path)
    return model


def evaluate_holdout(events: DataFrame, test_size: float = 0.2, seed: int = 42,
                     settings: ForestSettings = ForestSettings(), names=FEATURES,
                     keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored test rows, metrics, cost) of a model that never saw the test rows (M7).

    ``keep`` names event fields that the scored rows carry on, for a preview of the misclassified ones.
    """
    table = stored(labelled_features(stratified_holdout(events, test_size, Order(seed)), names,
                                     ("part", *keep)), ("part",))
    model = fit_forest(table.filter(F.col("part") == "train"), names, settings, store=False)
    scored = score(model, table.filter(F.col("part") == "test"), ["event_key", "label", *keep]).select(
        "event_key", "label", *keep, "prediction", "confidence")
    return scored, binary_metrics(scored), cost_comparison(scored)


def disagreement_training_rows(events: DataFrame, seed: int = 42) -> DataFrame:
    """Rows on which reviewer and truth differ (``_target`` 1) and as many others, the first in a random order."""
    agree, disagree = split_by_agreement(events)
    # Counting and choosing need the keys alone; the features are computed for the chosen rows.
    negatives = choose_count(agree, disagree.select("event_key").count(), Order(seed, "negatives", stratum=None))
    return disagree.withColumn("_target", F.lit(1.0)).unionByName(negatives.withColumn("_target", F.lit(0.0)))


def fit_disagreement_model(
    events: DataFrame, seed: int = 42, with_mismatch: bool = False,
    settings: ForestSettings = ForestSettings(trees=100, depth=5), base=FEATURES,
) -> ForestModel:
    """Model of "reviewer and truth differ", fitted on ``disagreement_training_rows``."""
    both = disagreement_training_rows(events, seed)
    names = [*base, *DISAGREEMENT] + ([LABEL_MISMATCH] if with_mismatch else [])
    table = disagreement_features(both, ("event_key", "_target"), base, with_mismatch=with_mismatch)
    return fit_forest(table, names, settings, target=F.col("_target"))


def score_disagreement(events: DataFrame, model: ForestModel, with_mismatch: bool = False,
                       base=FEATURES) -> DataFrame:
    """Probability per event that reviewer and truth differ. Only the features that some split uses are computed."""
    used = set(model.used)
    table = disagreement_features(events, ("event_key",), [n for n in base if n in used], with_mismatch=with_mismatch)
    return score(model, table.select("event_key", *[n for n in table.columns if n in used]), ["event_key"]).select(
        "event_key", (F.col("p_malicious") > 0.5).cast("int").alias("disagreement"),
        F.col("p_malicious").alias("p_disagreement"))
