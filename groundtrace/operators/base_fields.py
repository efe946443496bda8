"""Stage 1 of the feature table: the resolved and lower-cased fields every rule reads."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace.functions.paths import basename
from groundtrace.functions.text import nz
from groundtrace.operators.prepare import field, image_of


@dataclass(frozen=True)
class RuleOptions:
    """Switches for rules whose published form has a quirk.

    path_semantics: "windows" (default) or "posix" file-name splitting.
    fix_case: also match the three indicators written with capitals.
    fix_paths: match ordinary paths where the literals hold doubled back-slashes.
    """

    path_semantics: str = "windows"
    fix_case: bool = False
    fix_paths: bool = False


def base_columns(df: DataFrame, options: RuleOptions) -> dict[str, Column]:
    image, parent = image_of(df), nz(field(df, "ParentImage"))
    command, user = nz(field(df, "CommandLine")), nz(field(df, "User"))
    return {
        "_cmd": command,
        "_lc": F.lower(command),
        "_len": F.length(command),
        "_path": image,
        "_img": F.lower(image),
        "_exe": basename(F.lower(image), options.path_semantics),
        "_par": F.lower(parent),
        "_pexe": basename(F.lower(parent), options.path_semantics),
        "_pcmd": F.lower(nz(field(df, "ParentCommandLine"))),
        "_user": user,
        "_uuser": F.upper(user),
        "_domain": nz(field(df, "Domain")),
        "_integ": F.lower(nz(field(df, "IntegrityLevel"))),
        "_time": nz(field(df, "EventTime")),
        "_proto": nz(field(df, "Protocol")),
        "_dip": nz(field(df, "DestinationIp")),
        "_id": F.coalesce(field(df, "EventID"), F.lit(0)),
        "_pid": F.coalesce(field(df, "ProcessId"), F.lit(0).cast("bigint")),
        "_ppid": F.coalesce(field(df, "ParentProcessId"), F.lit(0).cast("bigint")),
        "_sport": F.coalesce(field(df, "SourcePort"), F.lit(0)),
        "_dport": F.coalesce(field(df, "DestinationPort"), F.lit(0)),
    }
