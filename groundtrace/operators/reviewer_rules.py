"""Features from the reviewer's verdict (F-RSN) and for disagreement models (F-DIS)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace import schema
from groundtrace import vocabulary as v
from groundtrace.functions import text as t
from groundtrace.functions.paths import basename
from groundtrace.operators.base_fields import RuleOptions
from groundtrace.operators.event_rules import _coded
from groundtrace.operators.feature_table import FEATURES, features_of_batch
from groundtrace.operators.prepare import image_of

REASON = tuple(v.REASON_WORDS) + (
    "claude_confidence_encoded", "reasoning_length", "reasoning_word_count",
    "has_attack_technique")
DISAGREEMENT = (
    "claude_confidence_encoded", "reason_mentions_standard", "reason_mentions_suspicious",
    "reason_length", "has_attack_technique", "disagreement_explorer_userinit",
    "disagreement_system_account", "disagreement_compression", "disagreement_discovery")
LABEL_MISMATCH = "label_mismatch"


def _confidence(reviewer: Column) -> Column:
    return _coded(F.lower(t.nz(reviewer["confidence"])), v.CONFIDENCE_CODES)


def reason_features(df: DataFrame, keep: Sequence[str] = ("event_key",)) -> DataFrame:
    """Word-list features of the reviewer's reason; null where the reviewer gave no verdict."""
    reviewer = F.col(schema.REVIEWER)
    staged = df.select(*keep, reviewer, t.nz(reviewer["reason"]).alias("_reason"),
                       F.lower(t.nz(reviewer["reason"])).alias("_lower"))
    features = {n: t.flag(t.contains_any(F.col("_lower"), words))
                for n, words in v.REASON_WORDS.items()}
    features |= {
        "claude_confidence_encoded": _confidence(reviewer),
        "reasoning_length": F.length("_reason"),
        "reasoning_word_count": t.word_count(F.col("_reason")),
        "has_attack_technique": t.flag(t.nz(reviewer["attack_technique"]) != ""),
    }
    return staged.select(*keep, *[F.when(reviewer.isNotNull(), c).alias(n)
                                  for n, c in features.items()])


def disagreement_columns(df: DataFrame, truth: str, options: RuleOptions) -> dict[str, Column]:
    reviewer = F.col(schema.REVIEWER)
    command, reason = F.lower(t.nz(F.col("CommandLine"))), F.lower(t.nz(reviewer["reason"]))
    image, parent = F.lower(image_of(df)), F.lower(t.nz(F.col("ParentImage")))
    both = (image != "") & (parent != "")
    mismatch = t.nz(reviewer["predicted_label"]) != F.coalesce(F.col(truth), F.lit(v.BENIGN))
    return {
        LABEL_MISMATCH: t.flag(reviewer.isNotNull() & mismatch),
        "claude_confidence_encoded": _confidence(reviewer),
        "reason_mentions_standard": t.flag(t.contains_any(reason, v.DISAGREEMENT_STANDARD_WORDS)),
        "reason_mentions_suspicious": t.flag(
            t.contains_any(reason, v.DISAGREEMENT_SUSPICIOUS_WORDS)),
        "reason_length": F.length(t.nz(reviewer["reason"])),
        "has_attack_technique": t.flag(t.nz(F.col(schema.TECHNIQUE_FIELD)) != ""),
        "disagreement_explorer_userinit": t.flag(
            both & F.contains(basename(parent, options.path_semantics), F.lit("userinit.exe"))
            & F.contains(basename(image, options.path_semantics), F.lit("explorer.exe"))),
        "disagreement_system_account": t.flag(both & t.contains_any(
            F.upper(t.nz(F.col("User"))), ("SYSTEM", "NETWORK SERVICE"))),
        "disagreement_compression": t.flag(t.contains_any(command, v.DISAGREEMENT_COMPRESSION)),
        "disagreement_discovery": t.flag(t.contains_any(command, v.DISAGREEMENT_DISCOVERY)),
    }


def disagreement_features(
    df: DataFrame, keep: Sequence[str] = ("event_key",), base: Sequence[str] = FEATURES,
    truth: str = "label", with_mismatch: bool = False, options: RuleOptions = RuleOptions(),
) -> DataFrame:
    """Base features plus the disagreement columns.

    ``label_mismatch`` is the very thing a disagreement model predicts, so it is left out unless asked.
    """
    extra = disagreement_columns(df, truth, options)
    if not with_mismatch:
        extra.pop(LABEL_MISMATCH)
    widened = df.select("*", *[c.alias(f"_d_{n}") for n, c in extra.items()])
    carried = [f"_d_{n}" for n in extra]
    table = features_of_batch(widened, base, [*keep, *carried], options)
    return table.select(*keep, *base, *[F.col(f"_d_{n}").alias(n) for n in extra])
