"""The feature table: three stacked projections, no shuffle, no Python code per row.

base fields -> parts (patterns, entropy, raw scores; each computed once) -> published columns.
Requesting fewer names drops whatever only the other columns needed.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace.operators import event_rules as ev
from groundtrace.operators import native_rules as nat
from groundtrace.operators import obfuscation as obf
from groundtrace.functions.text import nz
from groundtrace.operators.base_fields import RuleOptions, base_columns
from groundtrace.operators.prepare import field, image_of
from groundtrace.session import compile_methods, stored

GROUPS = {
    "native": (nat.NATIVE, nat.native_rules),
    "technique": (nat.TECHNIQUE, nat.technique_rules),
    "anomaly": (nat.ANOMALY, nat.anomaly_rules),
    "usage": (nat.USAGE, nat.usage_rules),
    "context": (nat.CONTEXT, nat.context_rules),
    "obfuscation": (obf.OBFUSCATION, obf.obfuscation_rules),
    "event": (ev.EVENT, ev.event_rules),
    "command": (ev.COMMAND, ev.command_rules),
    "embedding": (ev.EMBEDDING, ev.embedding_rules),
    "relation": (ev.RELATION, ev.relation_rules),  # opt-in, not part of FEATURES
}
FEATURES = tuple(sorted(n for g, (names, _) in GROUPS.items() if g != "relation" for n in names))


def feature_table(
    events: DataFrame,
    names: Sequence[str] = FEATURES,
    keep: Sequence[str] = ("event_key",),
    options: RuleOptions = RuleOptions(),
    vector_col: str = "embedding",
) -> DataFrame:
    """``keep`` columns plus the requested features of prepared events."""
    compile_methods(events.sparkSession)
    wanted = set(names)
    base = base_columns(events, options)
    if vector_col in events.columns:
        base["_vec"] = F.coalesce(F.col(vector_col), F.array())
    else:
        base["_vec"] = F.array().cast("array<float>")
    parts, features = {}, {}
    for group_names, rules in GROUPS.values():
        if wanted & set(group_names):
            more_parts, more_features = rules(options)
            parts |= more_parts
            features |= more_features
    unknown = wanted - set(features)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    kept = list(keep)
    staged = events.select(*kept, *[c.alias(n) for n, c in base.items()])
    if parts:
        staged = staged.select("*", *[c.alias(n) for n, c in parts.items()])
    return staged.select(*kept, *[features[n].alias(n) for n in names])


def feature_group(
    events: DataFrame, group: str, keep: Sequence[str] = ("event_key",),
    options: RuleOptions = RuleOptions(), vector_col: str = "embedding",
) -> DataFrame:
    """The columns of one rule group."""
    return feature_table(events, GROUPS[group][0], keep, options, vector_col)


# Rules of the command group that look at the image or the parent; all others there, and all technique and
# obfuscation rules, look at the command alone.
ABOUT_IMAGES = ("is_system32_binary", "is_syswow64_binary", "is_windows_binary", "is_temp_binary", "image_path_depth",
                "parent_is_explorer", "parent_is_system", "parent_is_svchost")
COMMAND_FEATURES = tuple(sorted({*nat.TECHNIQUE, *obf.OBFUSCATION, *ev.COMMAND} - {*ABOUT_IMAGES}))


# Columns that differ from event to event: ids, ports, the clock, the vector. All others follow from an event's kind.
OF_EACH_EVENT = ("event_id", "is_process_create", "is_network_connection", "is_file_create", "process_id", "parent_process_id",
                 "has_parent", "event_hour", "is_off_hours", "has_network_activity", "source_port", "destination_port")
KIND_FEATURES = tuple(n for n in FEATURES if n not in {*OF_EACH_EVENT, *ev.EMBEDDING})


def _digest(*columns: Column) -> Column:
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def kind_fields(events: DataFrame) -> dict[str, Column]:
    """What the kind features read of an event, without nulls: six texts, and whether there is a peer on the network.

    The peer stands as a source port of 1 or 0, as the rules that ask for one look at the port or the address.
    """
    texts = ("CommandLine", "ParentImage", "User", "Domain", "IntegrityLevel")
    peer = (nz(field(events, "DestinationIp")) != "") | (F.coalesce(field(events, "SourcePort"), F.lit(0)) != 0)
    return {"Image": image_of(events), **{n: nz(field(events, n)) for n in texts}, "SourcePort": peer.cast("int")}


def _joined(events: DataFrame, fields: dict[str, Column], own: list[str], names, keep, options, vector_col) -> DataFrame:
    """The table with its columns ``own`` computed once per different combination of ``fields``."""
    keyed = events.withColumn("_digest", _digest(*fields.values()))
    different = keyed.select("_digest", *[c.alias(n) for n, c in fields.items()]).distinct()
    known = stored(feature_table(different, own, ("_digest",), options)).withColumnRenamed("_digest", "_of")
    others = [n for n in names if n not in own]
    rest = feature_table(keyed, others, [*keep, "_digest"], options, vector_col)
    return rest.join(known, F.col("_digest") == F.col("_of")).select(*keep, *names)


def feature_table_by_command(
    events: DataFrame, names: Sequence[str] = FEATURES, keep: Sequence[str] = ("event_key",),
    options: RuleOptions = RuleOptions(), vector_col: str = "embedding",
) -> DataFrame:
    """The same table for logs whose commands repeat: what follows from the command is computed once per command.

    Commands are reduced to the different ones, in each task first, and their columns are written; the table's true
    size then decides how it is joined back, and a command that makes up much of the log is no more than one of its
    rows. Where most commands occur once, ``feature_table`` is the cheaper form, as it moves nothing.
    """
    own = [n for n in names if n in COMMAND_FEATURES]
    if not own:
        return feature_table(events, names, keep, options, vector_col)
    return _joined(events, {"CommandLine": F.col("CommandLine")}, own, names, keep, options, vector_col)


def feature_table_by_kind(
    events: DataFrame, names: Sequence[str] = FEATURES, keep: Sequence[str] = ("event_key",),
    options: RuleOptions = RuleOptions(), vector_col: str = "embedding",
) -> DataFrame:
    """The same for logs in which command, images, account and integrity repeat together: a kind of event each."""
    own = [n for n in names if n in KIND_FEATURES]
    if not own:
        return feature_table(events, names, keep, options, vector_col)
    return _joined(events, kind_fields(events), own, names, keep, options, vector_col)


MANY = 50_000    # events from which it pays to look whether commands repeat
DIFFERENT = 20_000  # commands or kinds whose columns are small enough to be sent to every task
TIMES = 8        # events per different command or kind


def features_of_batch(
    events: DataFrame, names: Sequence[str] = FEATURES, keep: Sequence[str] = ("event_key",),
    options: RuleOptions = RuleOptions(), vector_col: str = "embedding",
) -> DataFrame:
    """The feature table in the form that suits the events: by kind or by command where a table's kinds or commands repeat.

    One aggregate over commands and kinds decides. Streams, small tables and those of many different commands take
    ``feature_table``, which moves nothing; nor does the other form here, as its few commands are sent to the tasks.
    """
    if events.isStreaming or not set(names) & set(KIND_FEATURES):
        return feature_table(events, names, keep, options, vector_col)
    compile_methods(events.sparkSession)
    n, commands, kinds = events.select("CommandLine", F.xxhash64(*kind_fields(events).values()).alias("_kind")).agg(
        F.count(F.lit(1)), F.approx_count_distinct("CommandLine"), F.approx_count_distinct("_kind")).first()
    few = min(DIFFERENT, n / TIMES)
    if n < MANY or commands > few:
        return feature_table(events, names, keep, options, vector_col)
    form = feature_table_by_kind if kinds <= few else feature_table_by_command
    return form(events, names, keep, options, vector_col)
