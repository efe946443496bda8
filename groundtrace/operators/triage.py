"""Rule classifiers: failure patterns, heuristic verdict, indicator hits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace import vocabulary as v
from groundtrace.functions import text as t
from groundtrace.functions.paths import basename
from groundtrace.operators.native_rules import points, total
from groundtrace.operators.prepare import field, image_of, user_of
from groundtrace.operators.rule_join import joined_hits


def _first_hit(words: tuple[str, ...], *texts: Column) -> Column:
    """First word of the list found in any text, null if none."""
    return F.coalesce(*[F.when(
        total_or([F.contains(x, F.lit(w)) for x in texts]), F.lit(w)) for w in words])


def total_or(conditions: list[Column]) -> Column:
    found = conditions[0]
    for condition in conditions[1:]:
        found = found | condition
    return found


def classify_failures(df: DataFrame) -> DataFrame:
    """Add ``failure_pattern`` and ``evidence``; the first matching pattern wins."""
    staged = df.select(
        "*", F.lower(t.nz(field(df, "CommandLine"))).alias("_c"), F.lower(image_of(df)).alias("_i"),
        F.lower(user_of(df)).alias("_u"))
    command, image, user = F.col("_c"), F.col("_i"), F.col("_u")
    staged = staged.select(
        "*", _first_hit(v.FAILURE_OBFUSCATION, command).alias("_o"),
        F.when((image != "") & ~image.isin(*v.FAILURE_KNOWN_IMAGES),
               _first_hit(v.FAILURE_NOVEL, command, image)).alias("_n"))
    hidden, novel = F.col("_o"), F.col("_n")
    privileged = t.contains_any(user, v.PRIVILEGED_USER_PARTS) | F.endswith(user, F.lit("$"))
    admin = t.contains_any(command, v.FAILURE_ADMIN) & privileged

    def quoted(template: str, word: Column) -> Column:
        before, after = template.split("%s")
        return F.concat(F.lit(before), word, F.lit(after))

    pattern = (F.when(hidden.isNotNull(), v.SUBTLE_OBFUSCATION)
               .when(admin, v.CONTEXT_LEGITIMATE)
               .when(novel.isNotNull(), v.NOVEL_TECHNIQUE).otherwise(v.UNMAPPED))
    evidence = (F.when(hidden.isNotNull(), quoted(v.EVIDENCE_OBFUSCATION, hidden))
                .when(admin, v.EVIDENCE_ADMIN)
                .when(novel.isNotNull(), quoted(v.EVIDENCE_NOVEL, novel))
                .otherwise(v.EVIDENCE_UNMAPPED))
    return staged.withColumn("failure_pattern", pattern).withColumn("evidence", evidence).drop(
        "_c", "_i", "_u", "_o", "_n")


def pattern_counts(classified: DataFrame) -> DataFrame:
    """Rows per failure pattern (A10)."""
    return classified.groupBy("failure_pattern").agg(F.count(F.lit(1)).alias("n"))


def heuristic_verdict(df: DataFrame, verdict: Column | None = None) -> DataFrame:
    """Add ``heuristic_score``, ``heuristic_verdict`` and ``heuristic_reasons`` (H1, H2).

    ``verdict`` replaces the heuristic's own label when reasons for another model are wanted.
    """
    staged = df.select(
        "*", t.nz(field(df, "CommandLine")).alias("_c"),
        F.lower(t.nz(field(df, "CommandLine"))).alias("_l"),
        F.lower(basename(image_of(df))).alias("_e"), F.upper(t.nz(field(df, "User"))).alias("_u"),
        t.nz(field(df, "IntegrityLevel")).alias("_g"))
    cmd, lc, exe = F.col("_c"), F.col("_l"), F.col("_e")
    encoded = t.contains_any(lc, ("-enc", "encoded"))
    bypass = t.contains_all(lc, "bypass", "executionpolicy")
    remote = F.contains(cmd, F.lit("/node:"))
    native = exe.isin(*v.HEURISTIC_BINARIES)
    score = total(points(2, encoded), points(2, bypass), points(2, remote),
                  points(1, t.contains_any(cmd, ("%", "\\x"))), points(1, native))
    scored = staged.withColumn("heuristic_score", score)
    own = F.when(F.col("heuristic_score") >= 2, v.MALICIOUS).otherwise(v.BENIGN)
    scored = scored.withColumn("heuristic_verdict", own if verdict is None else verdict)
    against = F.array_compact(F.array(
        F.when(native, F.concat(F.lit(v.REASON_NATIVE), exe)),
        F.when(encoded, v.REASON_ENCODED),
        F.when(bypass, v.REASON_BYPASS),
        F.when(remote, v.REASON_REMOTE),
        F.when(t.contains_any(cmd, ("%", "\\x", "0x")), v.REASON_OBFUSCATION),
        F.when(t.contains_any(F.col("_u"), ("SYSTEM", "NT AUTHORITY")), v.REASON_SYSTEM),
    ))
    in_favour = F.array_compact(F.array(
        F.when(t.contains_any(lc, v.HEURISTIC_ADMIN_COMMANDS), v.REASON_ADMIN),
        F.when(t.contains_any(F.col("_g"), ("Medium", "High")),
               F.concat(F.lit(v.REASON_INTEGRITY), F.col("_g"))),
    ))

    def joined(reasons: Column, fallback: str) -> Column:
        return F.when(F.size(reasons) > 0, F.array_join(reasons, ". ")).otherwise(fallback)

    reasons = F.when(F.col("heuristic_verdict") == v.MALICIOUS,
                     joined(against, v.REASON_MALICIOUS_FALLBACK)
                     ).otherwise(joined(in_favour, v.REASON_BENIGN_FALLBACK))
    return scored.withColumn("heuristic_reasons", reasons).drop("_c", "_l", "_e", "_u", "_g")


def technique_rule_list() -> list[tuple[str, str]]:
    return [(rule, word) for rule, words in v.TECHNIQUE_INDICATORS.items() for word in words]


def rule_hits(df: DataFrame, rules: list[tuple[str, str]] | DataFrame | None = None,
              keep: tuple[str, ...] = ("event_key",)) -> DataFrame:
    """Long form (keep..., rule, indicator), one row per indicator found in the command.

    A list, by default the fixed one, becomes a literal array filtered per row: no join, no shuffle. A
    table (rule, indicator) of any size is joined.
    """
    staged = df.select(*keep, F.lower(t.nz(field(df, "CommandLine"))).alias("_lc"))
    if isinstance(rules, DataFrame):
        return joined_hits(staged, rules, keep)
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(w).alias("indicator"))
                       for r, w in (technique_rule_list() if rules is None else rules)])
    found = F.filter(listed, lambda r: F.contains(F.col("_lc"), r["indicator"]))
    # The outer form spares a second evaluation of the array as a filter at the scan.
    return staged.select(*keep, F.inline_outer(found)).filter(F.col("rule").isNotNull())
