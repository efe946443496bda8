"""Text tests, counts and statistics as Column expressions (no Python UDF)."""

from collections.abc import Iterable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters between Unicode white space; \x1c-\x1f also separate words.
WORD = r"(?U)[^\s\x1c-\x1f]+"
NOT_ALPHANUMERIC = r"[^\p{L}\p{N}]+"
SPACE = r"(?U)[\s\x1c-\x1f]+"


def nz(text: Column) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(text, F.lit(""))


def first_nonempty(*texts: Column) -> Column:
    """First text that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def flag(condition: Column) -> Column:
    """Boolean to 0/1; null counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def contains_any(text: Column, words: Iterable[str], guard: str | None = None) -> Column:
    """Any of ``words`` occurs; ``guard`` is a literal all of them hold, tested first."""
    found = reduce(or_, [F.contains(text, F.lit(w)) for w in words])
    return found if guard is None else F.contains(text, F.lit(guard)) & found


def contains_all(text: Column, *words: str) -> Column:
    return F.contains(text, F.lit(words[0])) & F.contains(text, F.lit(words[1]))


def hits(text: Column, words: Iterable[str]) -> Column:
    """How many of ``words`` occur in ``text``."""
    return reduce(add, [F.contains(text, F.lit(w)).cast("int") for w in words])


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of ``part``; absent parts cost one search."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))
    if len(part) > 1:
        removed = (removed / F.lit(len(part))).cast("int")
    return F.when(F.contains(text, F.lit(part)), removed).otherwise(
        F.when(text.isNotNull(), F.lit(0)))


def count_of_any(text: Column, chars: Iterable[str]) -> Column:
    """Occurrences of any of the given single characters: what is left when all others go."""
    listed = "".join("\\" + ch if ch in "\\^-]&[" else ch for ch in chars)
    return F.length(F.regexp_replace(text, f"[^{listed}]+", ""))


def word_count(text: Column) -> Column:
    """Words between white space: each becomes one character, the white space goes."""
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), SPACE, ""))


def alphanumeric_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, NOT_ALPHANUMERIC, ""))


def space_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SPACE, ""))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def matches(text: Column, guard: str | None, pattern: str | None) -> Column:
    """Regex search behind a cheap test for a literal that every match must hold."""
    if pattern is None:
        return F.contains(text, F.lit(guard))
    found = text.rlike(pattern)
    return found if guard is None else F.contains(text, F.lit(guard)) & found


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the character histogram; 0 for empty text.

    The sorted characters form runs of equal characters; with run lengths n_i and total n the entropy
    is log2(n) - sum(n_i * log2(n_i)) / n. Runs of one add nothing and are not extracted.
    """
    total = F.length(text)
    in_order = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(in_order, F.lit(r"(?s)(.)\1+"), F.lit(0))
    weighted = F.aggregate(
        runs, F.lit(0.0), lambda acc, run: acc + F.length(run) * F.log2(F.length(run).cast("double")))
    bits = F.log2(total.cast("double")) - weighted / total
    return F.when(total > 0, F.greatest(bits, F.lit(0.0))).otherwise(F.lit(0.0))


FREQUENT = (" etaoinsrhldcumfpgwybvkxjqz\n.,-0123456789TASICMBPHWDRNEFLGOUJVKYXQZ"
            "/\\\"'()=:;<>_*+&%$#@!?[]{}|~^`\t\r")  # ASCII characters, the usual ones first


def entropy_of_long(text: Column) -> Column:
    """The same without sorting a text's characters: those of ``FREQUENT`` are taken out and counted one after the other.

    What is left gets shorter with each, and only the characters that remain at the end are sorted. The state of a step
    is (rest, bytes before the last removal, sum of n * log2(n)); a removal is counted by the step after it.
    """
    total = F.length(text)
    weight = lambda n: n * F.log2(F.greatest(n, F.lit(1)).cast("double"))

    def step(state: Column, ch: Column) -> Column:
        left = F.octet_length(state["rest"])
        return F.struct(F.replace(state["rest"], ch, F.lit("")).alias("rest"), left.alias("before"),
                        (state["sum"] + weight(state["before"] - left)).alias("sum"))

    def finish(state: Column) -> Column:
        in_order = F.array_join(F.sort_array(F.split(state["rest"], "")), "")
        runs = F.regexp_extract_all(in_order, F.lit(r"(?s)(.)\1+"), F.lit(0))
        others = F.aggregate(runs, F.lit(0.0), lambda acc, run: acc + weight(F.length(run)))
        return state["sum"] + weight(state["before"] - F.octet_length(state["rest"])) + F.when(
            state["rest"] != "", others).otherwise(0.0)

    start = F.struct(text.alias("rest"), F.octet_length(text).alias("before"), F.lit(0.0).alias("sum"))
    weighted = F.aggregate(F.array(*[F.lit(ch) for ch in FREQUENT]), start, step, finish)
    bits = F.log2(total.cast("double")) - weighted / total
    return F.when(total > 0, F.greatest(bits, F.lit(0.0))).otherwise(F.lit(0.0))
