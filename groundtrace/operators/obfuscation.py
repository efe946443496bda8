"""Obfuscation flags, scores and text statistics of a command (F-OBF, A17)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace import vocabulary as v
from groundtrace.functions import text as t
from groundtrace.operators.base_fields import RuleOptions
from groundtrace.operators.native_rules import Columns, points, total
from groundtrace.session import compile_methods

OBFUSCATION = tuple(f"obfuscation_{c}" for c in v.OBFUSCATION_PATTERNS) + (
    "cmdline_entropy", "high_entropy", "cmdline_length", "cmdline_ratio_alphanumeric",
    "cmdline_ratio_special", "num_suspicious_chars", "encoding_indicators", "nested_quotes",
    "nested_brackets", "command_chains", "powershell_obfuscation", "obfuscation_score",
    "num_obfuscation_patterns", "obfuscation_intensity")


def category_hits(text: Column, category: str) -> Column:
    """How many patterns of the category the text matches."""
    found = []
    for guard, pattern in v.OBFUSCATION_PATTERNS[category]:
        found.append(t.matches(text, guard, pattern).cast("int"))
    return total(*found)


def obfuscation_rules(options: RuleOptions) -> tuple[Columns, Columns]:
    cmd, lc, length = F.col("_cmd"), F.col("_lc"), F.col("_len")
    parts = {f"_obf_{c}": category_hits(cmd, c) for c in v.OBFUSCATION_PATTERNS}
    counts = [F.col(name) for name in parts]
    parts["_entropy"] = t.entropy(cmd)
    parts["_alnum"] = t.alphanumeric_count(cmd)
    entropy = F.col("_entropy")
    matched, categories = total(*counts), total(*[t.flag(c > 0) for c in counts])
    powershell = total(
        points(2, t.matches(cmd, "-enc", v.LONG_ENCODED_ARGUMENT)),
        points(1, F.contains(lc, F.lit("[char]")) | F.contains(cmd, F.lit("String.fromCharCode"))),
        points(1, t.count_of(lc, ".replace(") > 2),
        points(1, t.contains_any(lc, ("iex", "invoke-expression"))),
        points(1, t.contains_any(lc, ("downloadstring", "downloadfile"))),
    )

    def imbalance(opening: str, closing: str) -> Column:
        return F.abs(t.count_of(cmd, opening) - t.count_of(cmd, closing))

    features = {f"obfuscation_{c}": t.flag(F.col(f"_obf_{c}") > 0) for c in v.OBFUSCATION_PATTERNS}
    features |= {
        "cmdline_entropy": entropy,
        "high_entropy": t.flag(entropy > 4.5),
        "cmdline_length": length,
        "cmdline_ratio_alphanumeric": t.ratio(F.col("_alnum"), length),
        "cmdline_ratio_special": t.ratio(
            length - F.col("_alnum") - t.space_count(cmd), length),
        "num_suspicious_chars": t.count_of_any(cmd, v.SUSPICIOUS_CHARS),
        "encoding_indicators": t.count_of_any(cmd, v.ENCODING_CHARS),
        "nested_quotes": F.greatest(F.lit(0), t.count_of_any(cmd, ("'", '"', "`")) - 2),
        "nested_brackets": imbalance("(", ")") + imbalance("[", "]") + imbalance("{", "}"),
        "command_chains": (t.count_of(cmd, "&&") + t.count_of(cmd, "||") + t.count_of(cmd, ";")
                           + t.count_of(cmd, "|")),
        "powershell_obfuscation": F.when(
            t.contains_any(lc, ("powershell", "pwsh")), F.least(powershell, F.lit(5))
        ).otherwise(F.lit(0)),
        "obfuscation_score": F.least(matched * 0.1 + entropy / 10.0, F.lit(1.0)),
        "num_obfuscation_patterns": categories,
        "obfuscation_intensity": F.least(categories * 0.2 + entropy / 5.0, F.lit(1.0)),
    }
    return parts, features


def text_obfuscation(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The obfuscation columns of any text column, over the whole text."""
    compile_methods(df.sparkSession)
    text = t.nz(F.col(text_col))
    base = df.select(*keep, text.alias("_cmd"), F.lower(text).alias("_lc"),
                     F.length(text).alias("_len"))
    parts, features = obfuscation_rules(RuleOptions())
    parts["_entropy"] = t.entropy_of_long(F.col("_cmd"))
    staged = base.select("*", *[c.alias(n) for n, c in parts.items()])
    return staged.select(*keep, *[c.alias(n) for n, c in features.items()])


def text_entropy(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Shannon entropy per row of a (possibly long) text column; map-only."""
    return df.select(*keep, t.entropy(t.nz(F.col(text_col))).alias("entropy"))


SLICE = 1 << 18  # characters of a long text that are looked at together


def long_text_entropy(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The same for texts of any length, in two steps: characters counted per slice and row, entropy from the counts.

    No row holds more than a slice taken apart, and a row's counts are summed before they are shuffled. ``keep``
    must tell the rows apart.
    """
    text = t.nz(F.col(text_col))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(SLICE))
    slices = df.select(*keep, F.explode(F.transform(starts, lambda i: F.substring(text, i, F.lit(SLICE)))).alias("_slice"))
    counts = slices.select(*keep, F.explode(F.split("_slice", "")).alias("_char")).groupBy(*keep, "_char").agg(
        F.count(F.lit(1)).alias("_n"))
    n = F.when(F.col("_char") != "", F.col("_n")).otherwise(0)  # an empty text is one empty character
    total, weighted = F.sum(n), F.sum(F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0))
    bits = F.greatest(F.log2(total.cast("double")) - weighted / total, F.lit(0.0))
    return counts.groupBy(*keep).agg(F.when(total > 0, bits).otherwise(0.0).alias("entropy"))
