"""Join of commands with a table of indicators of any size, by the rarest gram of each indicator.

Tables that every task can hold are scanned for instead (``rule_scan``).

An indicator is found where its characters occur in a command, so each of its grams does. How many different commands
hold a gram is counted first; an indicator is looked up by its rarest gram only, and not at all if one of its grams
occurs in no command. Rules that share a beginning, or a frequent word, so meet only the commands that also hold what
is particular to each. A gram that stays frequent is dealt out over several salts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace.operators.rule_scan import SMALL, scanned_hits

GRAM = 4  # characters; shorter indicators are looked up whole
HOT = 10_000  # commands that one salt of a gram holds on average
SLICES = (1 << 16, 1 << 8)  # characters; a text of any length is cut in two steps before its grams are listed


def _grams(text: Column, size: int) -> Column:
    """Different runs of ``size`` characters; the empty run is in every text."""
    if size == 0:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.array_distinct(F.filter(cut, lambda g: F.length(g) == size))


def _indicator_grams(known: DataFrame) -> DataFrame:
    """(indicator, gram): all grams of long indicators, short ones whole."""
    text = F.col("indicator")
    grams = F.when(F.length(text) >= GRAM, _grams(text, GRAM)).otherwise(F.array(text))
    return known.select("indicator").distinct().select("indicator", F.explode(grams).alias("gram"))


def _command_grams(commands: DataFrame, sizes: list[int]) -> DataFrame:
    """(digest, gram), a gram once per slice: no row holds the grams of a long text, nor is one read from its start."""
    for size in SLICES:
        starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(size))
        commands = commands.select("digest", F.explode(F.transform(starts, lambda i: F.substring(
            F.col("text"), i, F.lit(size + GRAM - 1)))).alias("text"))
    grams = F.flatten(F.array(*[_grams(F.col("text"), size) for size in sizes]))
    return commands.select("digest", F.explode(grams).alias("gram"))


def candidates(commands: DataFrame, known: DataFrame, hot: int = HOT) -> DataFrame:
    """(digest, indicator) of commands that hold the rarest gram of an indicator, from (digest, text) and (indicator)."""
    grams = _indicator_grams(known)
    sizes = sorted(r[0] for r in known.select(F.least(F.length("indicator"), F.lit(GRAM))).distinct().collect())  # GRAM + 1 at most
    if not sizes:
        return commands.select("digest").crossJoin(known.select("indicator").limit(0))
    held = _command_grams(commands, sizes)
    wanted = grams.select(F.col("gram").alias("of")).distinct()
    counts = held.join(wanted, F.col("gram") == F.col("of"), "left_semi").groupBy(F.col("gram").alias("of")).agg(
        F.count(F.lit(1)).alias("n"))
    placed = grams.join(counts, F.col("gram") == F.col("of"), "left")
    rarest = placed.groupBy("indicator").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    anchors = rarest.select("indicator", F.col("r.gram").alias("anchor"), F.ceil(F.col("r.n") / F.lit(hot)).cast("int").alias("salts"))
    asked = anchors.select(F.col("anchor").alias("of"), F.col("salts").alias("of_salts")).distinct()
    salt = F.pmod(F.col("digest.b"), F.col("of_salts")).cast("int")
    met = held.join(asked, F.col("gram") == F.col("of")).select("digest", "gram", salt.alias("salt")).distinct()
    spread = anchors.select("indicator", "anchor", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part"))
    return met.join(spread, (F.col("gram") == F.col("anchor")) & (F.col("salt") == F.col("part"))).select("digest", "indicator")


def joined_hits(staged: DataFrame, rules: DataFrame, keep: tuple[str, ...], small: int = SMALL) -> DataFrame:
    """(keep..., rule, indicator) from rows with a lower-cased command ``_lc``.

    Rules of up to ``small`` bytes are sent to the texts, which are scanned where they are. For more rules equal commands
    are looked up once, and only digests and grams travel until a candidate meets its command again. An
    empty indicator is found in every command, a null one in none; rules given twice count once.
    """
    known = rules.select("rule", "indicator").filter(F.col("indicator").isNotNull()).distinct()
    size = known.agg(F.sum(F.octet_length("indicator") + F.coalesce(F.octet_length("rule"), F.lit(0)) + 8)).first()[0] or 0
    if size <= small:
        return scanned_hits(staged, [(r["rule"], r["indicator"]) for r in known.collect()], keep)
    digest = F.struct(F.xxhash64("_lc").alias("a"), F.xxhash64(F.lit(1), F.col("_lc")).alias("b"))
    keyed = staged.withColumn("_digest", digest)
    commands = keyed.select(F.col("_digest").alias("digest"), F.col("_lc").alias("text")).distinct()
    found = commands.join(candidates(commands, known).withColumnRenamed("digest", "_d"), F.col("digest") == F.col("_d")).filter(
        F.contains("text", "indicator")).select("digest", F.col("indicator").alias("_i"))
    named = found.join(known, F.col("_i") == F.col("indicator")).select("digest", "rule", "indicator")
    return keyed.join(named, F.col("_digest") == F.col("digest")).select(*keep, "rule", "indicator")
