"""Events in, verdict with drivers and explanation out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace import vocabulary as v
from groundtrace.operators.base_fields import RuleOptions
from groundtrace.operators.contributions import (
    contribution_items, drivers_text, needed_features, with_explanation, with_strongest,
)
from groundtrace.operators.feature_table import features_of_batch
from groundtrace.operators.forest import ForestModel, score
from groundtrace.operators.tree_attributions import top_attributions
from groundtrace.session import filter_here


def score_events(events: DataFrame, model: ForestModel, keep: tuple[str, ...] = ("event_key",),
                 contributions: bool = False, options: RuleOptions = RuleOptions()) -> DataFrame:
    """Prepared events to (keep, prediction, confidence[, top_features, drivers]).

    One narrow pass: only the features the model uses (and those a contribution can name) are computed.
    Works on batch and streaming input alike.
    """
    carried = list(keep)
    needed = needed_features(model.importances) if contributions else []
    names = [n for n in model.names if n in {*model.used, *needed, *carried}]
    table = features_of_batch(events, names, carried, options)
    scored = score(model, table, carried)
    if not contributions:
        return scored.select(*carried, "prediction", "confidence", "p_malicious")
    importances = {n: model.importances[n] for n in needed}
    items = contribution_items(importances, model.statistics)
    return with_strongest(scored, [*carried, "prediction", "confidence", "p_malicious"], items).withColumn("drivers", drivers_text(F.col("top_features")))


TEXT_FIELDS = ("Image", "SourceImage", "User")


def explain_events(events: DataFrame, model: ForestModel, keep: tuple[str, ...] = ("event_key",),
                   exact: bool = False, alerts_only: bool = False) -> DataFrame:
    """prediction, confidence and explanation text per event.

    ``exact`` uses the tree attributions (one Arrow pass) instead of the cheap contributions;
    ``alerts_only`` explains the malicious verdicts only, which keeps that pass small.
    """
    carried = [*keep, *[c for c in TEXT_FIELDS if c not in keep]]
    if not exact:
        scored = score_events(events, model, tuple(carried), contributions=True)
        if alerts_only:
            scored = filter_here(scored, F.col("prediction") == v.MALICIOUS)
    else:
        table = features_of_batch(events, model.names, carried)
        scored = score(model, table, carried)
        if alerts_only:
            scored = filter_here(scored, F.col("prediction") == v.MALICIOUS)
        scored = top_attributions(scored, model, (*carried, "prediction", "confidence"))
    return with_explanation(scored).select(
        *keep, "prediction", "confidence", "top_features", "explanation")


def labelled_features(events: DataFrame, names, extra: tuple[str, ...] = ()) -> DataFrame:
    """Feature table with key and label for training."""
    return features_of_batch(events, names, ["event_key", "label", *extra])
