"""Field resolution, sanitising and the text forms of an event. All map-only projections."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtrace import schema
from groundtrace.functions.text import first_nonempty, nz


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def field(df: DataFrame, name: str) -> Column:
    """The column, or a typed null where the input does not carry it."""
    if _has(df, name):
        return F.col(name)
    return F.lit(None).cast(schema.NUMBER_FIELDS.get(name, "string"))


def resolve_aliases(df: DataFrame) -> DataFrame:
    """Fill each field from its other spelling and type the numbers (operator P1).

    The first non-empty text wins; a spelling column ``alt_*`` is dropped afterwards. Numbers that do
    not parse become null, also under ANSI mode.
    """
    resolved = {}
    for name in schema.ALLOWED_FIELDS:
        candidates = [c for c in (name, schema.alt(name) if name in schema.SPELLINGS else name)
                      if _has(df, c)]
        candidates = list(dict.fromkeys(candidates))
        if not candidates:
            continue
        if name in schema.NUMBER_FIELDS:
            kind = schema.NUMBER_FIELDS[name]
            numbers = [F.col(c).try_cast(kind) for c in candidates]
            # A zero id counts as absent, so the other spelling may fill it.
            resolved[name] = F.coalesce(*[F.nullif(n, F.lit(0)) for n in numbers], *numbers)
        elif len(candidates) > 1:
            resolved[name] = F.nullif(first_nonempty(*[F.col(c) for c in candidates]), F.lit(""))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in resolved and not c.startswith("alt_")]
    return df.select(*keep, *[c.alias(n) for n, c in resolved.items()])


def sanitize_events(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep the production fields only (operator P2); absent ones appear as null.

    ``keep`` names bookkeeping columns, such as the event key, that must travel along.
    """
    extra = [F.col(c) for c in keep if c not in schema.ALLOWED_FIELDS]
    return df.select(*extra, *[field(df, n).alias(n) for n in schema.ALLOWED_FIELDS])


def prepare_events(df: DataFrame, keep: tuple[str, ...] = ("event_key",)) -> DataFrame:
    """Spelling resolution and sanitising in one projection step."""
    return sanitize_events(resolve_aliases(df), keep)


def image_of(df: DataFrame) -> Column:
    return first_nonempty(field(df, "Image"), field(df, "SourceImage"))


def user_of(df: DataFrame) -> Column:
    return first_nonempty(field(df, "User"), field(df, "AccountName"))


def event_snapshot(df: DataFrame, *extra: str, truth: str = "label") -> DataFrame:
    """The short form of an event in reports (operator P5); ``extra`` columns are kept as they are."""
    return df.select(
        F.col("event_key"),
        F.col(truth).alias("ground_truth"),
        nz(field(df, "CommandLine")).alias("command_line"),
        image_of(df).alias("image"),
        user_of(df).alias("user"),
        nz(field(df, "ParentImage")).alias("parent_image"),
        *[F.col(c) for c in extra],
    )


def _labelled(prefix: str, value: Column, suffix: str = "") -> Column:
    """prefix + value + suffix, null (skipped by concat_ws) where the value is empty."""
    return F.when(value != "", F.concat(F.lit(prefix), value, F.lit(suffix)))


def prompt_text(df: DataFrame) -> Column:
    """``[time] | PID= | User= | Image= | CMD=`` without the empty parts (operator P6)."""
    pid = F.nullif(field(df, "ProcessId"), F.lit(0)).cast("string")
    return F.concat_ws(
        " | ",
        _labelled("[", nz(field(df, "EventTime")), "]"),
        _labelled("PID=", nz(pid)),
        _labelled("User=", nz(field(df, "User"))),
        _labelled("Image=", image_of(df)),
        _labelled("CMD=", nz(field(df, "CommandLine"))),
    )


def embedding_text(df: DataFrame) -> Column:
    """The text an encoder gets for an event (operator P9)."""
    return F.concat_ws(
        " | ",
        _labelled("Command: ", nz(field(df, "CommandLine"))),
        _labelled("Image: ", image_of(df)),
        _labelled("Parent: ", nz(field(df, "ParentImage"))),
        _labelled("User: ", nz(field(df, "User"))),
    )


def distillation_pairs(df: DataFrame) -> DataFrame:
    """(prompt, response) of every event the reviewer judged (operators P7, P8)."""
    reviewer = F.col(schema.REVIEWER)
    prompt = prompt_text(df)
    response = F.concat(
        F.lit("Label: "), F.coalesce(reviewer["predicted_label"], F.lit("benign")), F.lit(". "),
        nz(reviewer["reason"]))
    pairs = df.filter(reviewer.isNotNull()).select(
        "event_key", prompt.alias("prompt"), response.alias("response"))
    return pairs.filter(F.col("prompt") != "").withColumn(
        "text", F.concat("prompt", F.lit(" <|endoftext|> "), "response", F.lit(" <|endoftext|>")))


EXPAND = 1 << 16  # copies of a row that one array numbers


def with_content_key(df: DataFrame) -> DataFrame:
    """Add ``event_key``, a digest of the whole row. Map-only, so it also serves streams; equal rows share it."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256)
    return df.withColumn("event_key", digest)


def with_event_key(df: DataFrame, salts: int = 1024) -> DataFrame:
    """Give rows without an id a stable key: content digest plus occurrence number.

    Equal rows are interchangeable, so they are first counted per (row, salt) - the salt spreads a row
    that holds a large share of all copies - and expanded again with numbers that continue across the
    salts of one digest. Only the counts, never the copies, meet in one group.
    """
    columns = df.columns
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])), 256)
    counted = (
        df.withColumn("_digest", digest)
        .withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("_digest", "_salt")
        .agg(F.count(F.lit(1)).alias("_n"),
             *[F.any_value(F.col(f"`{c}`")).alias(c) for c in columns])
    )
    before = Window.partitionBy("_digest").orderBy("_salt").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    numbered = counted.withColumn("_end", F.sum("_n").over(before))
    # In two steps: a row that makes up a large share of the input never becomes one long array.
    steps = numbered.withColumn("_from", F.explode(F.sequence(
        F.col("_end") - F.col("_n") + 1, F.col("_end"), F.lit(EXPAND))))
    spread = steps.withColumn("_occurrence", F.explode(F.sequence(
        "_from", F.least(F.col("_from") + EXPAND - 1, F.col("_end")))))
    return spread.select(
        F.concat_ws("-", "_digest", F.col("_occurrence").cast("string")).alias("event_key"),
        *[F.col(f"`{c}`") for c in columns])
