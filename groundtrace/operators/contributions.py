"""Local contributions, attack type and explanation texts.

All of it stays in the row: arrays of (name, value, contribution), no shuffle.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace import vocabulary as v
from groundtrace.functions.paths import basename
from groundtrace.functions.text import first_nonempty
from groundtrace.operators.feature_table import FEATURES
from groundtrace.operators.metrics import standardised
from groundtrace.operators.reviewer_rules import DISAGREEMENT

ITEM = "array<struct<name:string,value:double,contribution:double>>"


Item = tuple[str, Column, Column]  # name, value, contribution


def item_array(items: Sequence[Item]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), x.alias("value"), c.alias("contribution"))
                     for n, x, c in items])


def strongest(items: Sequence[Item], k: int = 5, ties: str = "last") -> Column:
    """The k items with the largest |contribution|; equal ones by later or earlier position."""
    sign = 1 if ties == "last" else -1
    keyed = F.array(*[F.struct(
        F.abs(c).alias("size"), F.lit(i * sign).alias("place"), F.lit(n).alias("name"),
        x.alias("value"), c.alias("contribution")) for i, (n, x, c) in enumerate(items)])
    best = F.slice(F.sort_array(keyed, asc=False), 1, k)
    return F.transform(best, lambda x: F.struct(
        x["name"].alias("name"), x["value"].alias("value"),
        x["contribution"].alias("contribution")))


def with_strongest(df: DataFrame, keep: Sequence[str], items: Sequence[Item], k: int = 5) -> DataFrame:
    """keep columns plus ``top_features``, the ``strongest`` items of many; equal ones by later position.

    The sizes alone are ordered, as plain numbers; items are made only of those that reach the k-th size.
    """
    sizes = F.array(*[F.coalesce(F.abs(c), F.lit(-1.0)) for _, _, c in items])  # a missing one comes last
    listed = df.select(*keep, sizes.alias("_sizes"), F.array(*[x for _, x, _ in items]).alias("_values"),
                       F.array(*[c for _, _, c in items]).alias("_contributions"))
    least = F.element_at(F.sort_array("_sizes"), -min(k, len(items)))
    # Named twice, so that the optimiser leaves it in its own projection and the sizes are ordered once a row.
    reached = F.filter(F.sequence(F.lit(0), F.lit(len(items) - 1)), lambda i: (F.get("_sizes", i) > F.col("_least")) | (F.get("_sizes", i) == F.col("_least")))
    names = F.array(*[F.lit(n) for n, _, _ in items])
    keyed = F.transform(reached, lambda i: F.struct(F.get("_sizes", i).alias("size"), i.alias("place")))
    best = F.transform(F.slice(F.sort_array(keyed, asc=False), 1, k), lambda x: F.struct(
        F.get(names, x["place"]).alias("name"), F.get("_values", x["place"]).alias("value"),
        F.get("_contributions", x["place"]).alias("contribution")))
    return listed.select("*", least.alias("_least")).select(*keep, best.alias("top_features"))


def needed_features(importances: dict[str, float], k: int = 5) -> list[str]:
    """Features that can reach a top-k: all with importance, and the last k without (they give 0)."""
    names = list(importances)
    idle = [n for n in names if importances[n] == 0.0][-k:]
    return [n for n in names if importances[n] != 0.0 or n in idle]


def contribution_items(importances: dict[str, float],
                       statistics: dict[str, tuple[float, float]], k: int = 5) -> list[Item]:
    """(name, raw value, z-score x importance) of the features that matter."""
    return [(n, F.col(n).cast("double"),
             standardised(n, *statistics[n]) * F.lit(float(importances[n])))
            for n in needed_features(importances, k)]


def local_contributions(table: DataFrame, importances: dict[str, float],
                        statistics: dict[str, tuple[float, float]], keep: Sequence[str],
                        k: int = 5) -> DataFrame:
    """keep columns plus ``top_features`` and ``drivers``."""
    items = contribution_items(importances, statistics, k)
    ranked = with_strongest(table, keep, items, k)
    return ranked.withColumn("drivers", drivers_text(F.col("top_features")))


def drivers_text(top: Column) -> Column:
    """Up to three positive and three negative names in two phrases."""

    def names(keep_if) -> Column:
        return F.transform(F.slice(F.filter(top, keep_if), 1, 3), lambda x: x["name"])

    up = names(lambda x: x["contribution"] > 0)
    down = names(lambda x: x["contribution"] < 0)
    return F.concat_ws(
        "; ",
        F.when(F.size(up) > 0, F.concat(F.lit("Key indicators: "), F.array_join(up, ", "))),
        F.when(F.size(down) > 0, F.concat(F.lit("Mitigating factors: "), F.array_join(down, ", "))))


def first_case(tests: list[tuple[Column, object]], default: object = None) -> Column:
    """One flat CASE: the value of the first true test."""
    (condition, value), *others = tests
    case = F.when(condition, value)
    for condition, value in others:
        case = case.when(condition, value)
    return case.otherwise(default)


def attack_type_name(name: str) -> str:
    """Attack type of a feature: exact name, else the first key contained in it; empty if none."""
    return v.ATTACK_TYPES.get(name) or next((kind for key, kind in v.ATTACK_TYPES.items() if key in name.lower()), "")


def attack_type_of(name: Column) -> Column:
    """Attack type of a feature, null if none.

    The types of the known features are resolved when the plan is built; only other names are tested by row.
    """
    known = F.try_element_at(F.create_map(*[F.lit(x) for n in (*FEATURES, *DISAGREEMENT) for x in (n, attack_type_name(n))]), name)
    lowered = F.lower(name)
    tests = [(name == key, kind) for key, kind in v.ATTACK_TYPES.items()]
    tests += [(F.contains(lowered, F.lit(key)), kind) for key, kind in v.ATTACK_TYPES.items()]
    return F.when(known.isNotNull(), F.nullif(known, F.lit(""))).otherwise(first_case(tests))


def typed_contributions(top: Column) -> Column:
    """(attack type, |contribution|) of the items that point to one."""
    return F.filter(
        F.transform(F.slice(top, 1, 5), lambda x: F.struct(
            attack_type_of(x["name"]).alias("kind"), F.abs(x["contribution"]).alias("size"))),
        lambda x: x["kind"].isNotNull() & (x["size"] > 0))


def infer_attack_type(top: Column) -> Column:
    """The attack type with the largest summed |contribution|; the first seen wins a tie."""
    typed = typed_contributions(top)
    kinds = F.array_distinct(F.transform(typed, lambda x: x["kind"]))
    totals = F.transform(kinds, lambda kind, i: F.struct(
        F.aggregate(typed, F.lit(0.0), lambda acc, x: acc + F.when(
            x["kind"] == kind, x["size"]).otherwise(F.lit(0.0))).alias("total"),
        (-i).alias("order"), kind.alias("kind")))
    return F.coalesce(F.array_max(totals)["kind"], F.lit(v.ATTACK_UNCERTAIN))


def attack_scores(df: DataFrame, items: str = "top_features") -> DataFrame:
    """Summed |contribution| per (event_key, attack_type) of the top features."""
    typed = df.select("event_key", F.inline_outer(typed_contributions(F.col(items))))
    return typed.filter(F.col("kind").isNotNull()).groupBy("event_key", F.col("kind").alias("attack_type")).agg(
        F.sum("size").alias("score"))


def long_contributions(df: DataFrame, items: str = "top_features",
                       keep: Sequence[str] = ("event_key",)) -> DataFrame:
    """(keep..., rank, feature, value, contribution), one row per item."""
    # The outer form spares a second evaluation of the array as a filter at the scan.
    exploded = df.select(*keep, F.posexplode_outer(items).alias("_at", "_item"))
    return exploded.filter(F.col("_at").isNotNull()).select(
        *keep, (F.col("_at") + 1).alias("rank"), F.col("_item")["name"].alias("feature"),
        F.col("_item")["value"].alias("value"), F.col("_item")["contribution"].alias("contribution"))


def describe_features(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Add ``description`` from the fixed dictionary, a default text otherwise."""
    spark = df.sparkSession
    words = spark.createDataFrame(list(v.FEATURE_DESCRIPTIONS.items()),
                                  "_name string, description string")
    joined = df.join(F.broadcast(words), F.col(feature) == F.col("_name"), "left").drop("_name")
    return joined.withColumn("description", F.coalesce("description", F.lit(v.NO_DESCRIPTION)))


def _number(value: Column) -> Column:
    size = F.abs(value)
    return (F.when(size < 0.001, "0").when(size < 1, F.format_string("%.3f", value))
            .otherwise(F.format_string("%.2f", value)))


def _small(value: Column) -> Column:
    return F.when(F.abs(value) >= 0.001, F.format_string("%.3f", value)).otherwise("0.000")


def explain_feature(name: Column, value: Column, contribution: Column, benign: Column,
                    exe: Column, user: Column) -> Column:
    """One sentence about a feature."""
    numbers = F.concat(F.lit("** (value: "), _number(value), F.lit(", SHAP: "),
                       _small(contribution), F.lit("): "))

    def sentence(title: Column, text: Column) -> Column:
        return F.concat(F.lit("**"), title, numbers, text)

    def fill(template: str, values: dict[str, Column]) -> Column:
        pieces, rest = [], template
        while "{" in rest:
            before, after = rest.split("{", 1)
            slot, rest = after.split("}", 1)
            pieces += [F.lit(before), values[slot]]
        return F.concat(*pieces, F.lit(rest))

    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    direction = F.when((contribution > 0) & ~benign, v.FALLBACK_MALICIOUS).otherwise(
        v.FALLBACK_BENIGN)
    cases = []
    for how, key, title, text in v.SENTENCES:
        if how == "entropy":
            high, normal = v.HIGH_ENTROPY_SENTENCE, v.NORMAL_ENTROPY_SENTENCE
            spoken = F.when(value > 4.5, sentence(F.lit(high[0]), F.lit(high[1]))).otherwise(
                sentence(F.lit(normal[0]), F.lit(normal[1])))
            cases.append((F.contains(name, F.lit(key)), spoken))
            continue
        kind = F.replace(F.replace(name, F.lit(key), F.lit("")), F.lit("_"), F.lit(" "))
        values = {"exe": exe, "user": user, "kind": kind, "kind:title": F.initcap(kind)}
        named = (F.startswith(name, F.lit(key)) if how == "prefix"
                 else F.contains(name, F.lit(key)))
        cases.append((named & (value > 0), sentence(fill(title, values), fill(text, values))))
    embedded = F.startswith(name, F.lit("text_embedding_"))
    for part, title, text in v.EMBEDDING_SENTENCES:
        values = {"dim": F.substring_index(name, "_", -1)}
        cases.append((embedded & F.contains(name, F.lit(part)),
                      sentence(fill(title, values), F.lit(text))))
    return first_case(cases, sentence(F.initcap(spaced), direction))


def explanation(top: Column, prediction: Column, confidence: Column, exe: Column,
                user: Column) -> Column:
    """Verdict, attack type (malicious only) and numbered sentences."""
    benign = prediction != v.MALICIOUS
    lines = F.array_join(F.transform(top, lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(". "),
        explain_feature(x["name"], x["value"], x["contribution"], benign, exe, user))), "\n")
    percent = F.format_string("%.0f%%", confidence * 100)
    verdict = F.concat(F.lit("This event is classified as **"),
                       F.when(benign, v.BENIGN).otherwise(v.MALICIOUS), F.lit("** with "), percent,
                       F.lit(" confidence."))
    malicious = F.concat(verdict, F.lit("\n**Attack Type**: "), infer_attack_type(top),
                         F.lit("\n\n**Top Contributing Features:**\n\n"), lines)
    cleared = F.concat(verdict, F.lit("\n\n**Key Indicators (Top Features):**\n\n"), lines)
    return F.when(benign, cleared).otherwise(malicious)


def with_explanation(scored: DataFrame, top: str = "top_features") -> DataFrame:
    """Add ``explanation`` to rows with prediction, confidence, top features and event fields."""
    image = first_nonempty(F.col("Image"), F.col("SourceImage"))
    exe = F.when(image != "", basename(image)).otherwise("system binary")
    user = F.coalesce(F.col("User"), F.lit("N/A"))
    return scored.withColumn("explanation", explanation(
        F.col(top), F.col("prediction"), F.col("confidence"), exe, user))


def global_importance(df: DataFrame, items: str, names: Sequence[str], k: int = 10) -> DataFrame:
    """Mean |contribution| per feature over all rows, the k largest with descriptions.

    ``items`` is an array<double> in the order of ``names``. The rows are reduced to one row of
    ``len(names)`` means before anything is turned into long form.
    """
    means = df.agg(*[F.avg(F.abs(F.get(F.col(items), F.lit(i)))).alias(n)
                     for i, n in enumerate(names)])
    listed = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance"))
                       for n in names])
    long = means.select(F.inline(listed))
    best = long.orderBy(F.desc("importance"), "feature").limit(k)
    return describe_features(best)
