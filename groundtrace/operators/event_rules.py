"""Event-field, command, path, relation and embedding rules (F-EVT, F-CMD, F-REL, F-EMB)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace import vocabulary as v
from groundtrace.functions import text as t
from groundtrace.functions.paths import path_depth
from groundtrace.operators.base_fields import RuleOptions
from groundtrace.operators.native_rules import Columns, pair_seen

EVENT = (
    "event_id", "is_process_create", "is_network_connection", "is_file_create",
    "integrity_level_encoded", "is_low_integrity", "is_high_integrity", "is_system_user",
    "is_network_service", "has_domain", "user_length", "domain_length",
    "system_account_admin_tool", "process_id", "parent_process_id", "has_parent", "event_hour",
    "is_off_hours", "has_network_activity", "source_port", "destination_port")
COMMAND = (
    "cmdline_word_count", "cmdline_char_count", "is_system32_binary", "is_syswow64_binary",
    "is_windows_binary", "is_temp_binary", "image_path_depth", "parent_is_explorer",
    "parent_is_system", "parent_is_svchost", "has_redirection", "has_piping", "has_chaining",
    "has_encoded_content", "has_quotes", "num_quotes", "num_slashes", "num_dashes", "num_equals",
    "is_powershell", "has_powershell_bypass", "has_network_cmd", "has_file_ops",
    "has_registry_ops", "has_service_ops", "suspicious_path_operation",
    "system_file_modification", "compression_operation", "process_discovery", "network_discovery")
RELATION = (
    "exe_name_length", "exe_is_common_binary", "parent_exe_name_length",
    "suspicious_parent_child", "explorer_from_userinit", "explorer_unusual_parent",
    "system_binary_from_explorer", "wmiprvse_unusual_parent", "parent_cmdline_similarity")
EMBEDDING = ("text_embedding_mean", "text_embedding_std", "text_embedding_min",
             "text_embedding_max")


def _coded(text: Column, codes: dict[str, int]) -> Column:
    (word, number), *others = codes.items()
    code = F.when(text == word, F.lit(number))
    for word, number in others:
        code = code.when(text == word, F.lit(number))
    return code.otherwise(F.lit(0))


def event_rules(options: RuleOptions) -> tuple[Columns, Columns]:
    event_id, integ, upper_user = F.col("_id"), F.col("_integ"), F.col("_uuser")
    network_service = F.contains(upper_user, F.lit("NETWORK SERVICE"))
    clock = F.regexp_extract(F.col("_time"), r"(\d{2}):\d{2}:\d{2}", 1)
    parts = {"_hour": F.coalesce(F.nullif(clock, F.lit("")).try_cast("int"), F.lit(12))}
    hour = F.col("_hour")
    return parts, {
        "event_id": event_id,
        "is_process_create": t.flag(event_id == 1),
        "is_network_connection": t.flag(event_id == 3),
        "is_file_create": t.flag(event_id == 11),
        "integrity_level_encoded": _coded(integ, v.INTEGRITY_CODES),
        "is_low_integrity": t.flag(F.contains(integ, F.lit("low"))),
        "is_high_integrity": t.flag(t.contains_any(integ, ("high", "system"))),
        "is_system_user": t.flag(t.contains_any(upper_user, ("SYSTEM", "NT AUTHORITY"))),
        "is_network_service": t.flag(network_service),
        "has_domain": t.flag(F.col("_domain") != ""),
        "user_length": F.length("_user"),
        "domain_length": F.length("_domain"),
        "system_account_admin_tool": t.flag(
            network_service & t.contains_any(F.col("_img"), v.ADMIN_TOOLS + ("cmd.exe",))),
        "process_id": F.col("_pid"),
        "parent_process_id": F.col("_ppid"),
        "has_parent": t.flag(F.col("_ppid") != 0),
        "event_hour": hour,
        "is_off_hours": t.flag((hour < 6) | (hour > 22)),
        "has_network_activity": t.flag(
            (F.col("_sport") != 0) | (F.col("_dip") != "") | (F.col("_dport") != 0)
            | (F.col("_proto") != "")),
        "source_port": F.col("_sport"),
        "destination_port": F.col("_dport"),
    }


def _paths(literals: tuple[str, ...], options: RuleOptions) -> list[str]:
    return [p.replace("\\\\", "\\") for p in literals] if options.fix_paths else list(literals)


def command_rules(options: RuleOptions) -> tuple[Columns, Columns]:
    cmd, lc, img, par = F.col("_cmd"), F.col("_lc"), F.col("_img"), F.col("_par")

    def in_command(words, guard: str | None = None) -> Column:
        return t.flag(t.contains_any(lc, words, guard))

    slashes = "\\" if options.fix_paths else "\\\\"

    def in_image(*words: str) -> Column:
        return t.flag(t.contains_any(img, words))

    return {}, {
        "cmdline_word_count": t.word_count(cmd),
        "cmdline_char_count": F.col("_len"),
        "is_system32_binary": in_image("system32"),
        "is_syswow64_binary": in_image("syswow64"),
        "is_windows_binary": in_image("windows"),
        "is_temp_binary": in_image("temp", "appdata"),
        "image_path_depth": path_depth(F.col("_path"), options.path_semantics),
        "parent_is_explorer": t.flag(F.contains(par, F.lit("explorer.exe"))),
        "parent_is_system": t.flag(F.contains(par, F.lit("system"))),
        "parent_is_svchost": t.flag(F.contains(par, F.lit("svchost.exe"))),
        "has_redirection": t.flag(t.contains_any(cmd, (">", "<"))),
        "has_piping": t.flag(F.contains(cmd, F.lit("|"))),
        "has_chaining": t.flag(t.contains_any(cmd, ("&&", "||"))),
        "has_encoded_content": in_command(v.ENCODED_MARKERS),
        "has_quotes": t.flag(t.contains_any(cmd, ('"', "'"))),
        "num_quotes": t.count_of_any(cmd, ('"', "'")),
        "num_slashes": t.count_of_any(cmd, ("/", "\\")),
        "num_dashes": t.count_of(cmd, "-"),
        "num_equals": t.count_of(cmd, "="),
        "is_powershell": in_command(("powershell", "pwsh")),
        "has_powershell_bypass": t.flag(t.contains_all(lc, "bypass", "executionpolicy")),
        "has_network_cmd": in_command(v.NETWORK_COMMANDS),
        "has_file_ops": in_command(v.FILE_COMMANDS),
        "has_registry_ops": in_command(v.REGISTRY_COMMANDS, "reg "),
        "has_service_ops": in_command(v.SERVICE_COMMANDS),
        "suspicious_path_operation": in_command(
            _paths(v.SUSPICIOUS_PATHS, options), slashes),
        "system_file_modification": in_command(_paths(v.SYSTEM_FILES, options), slashes),
        "compression_operation": in_command(v.COMPRESSION_COMMANDS),
        "process_discovery": in_command(v.PROCESS_DISCOVERY_COMMANDS),
        "network_discovery": in_command(v.NETWORK_DISCOVERY_COMMANDS),
    }


def relation_rules(options: RuleOptions) -> tuple[Columns, Columns]:
    exe, parent = F.col("_exe"), F.col("_pexe")
    both = (F.col("_img") != "") & (F.col("_par") != "")
    explorer_parent = F.contains(parent, F.lit("explorer.exe"))
    explorer = F.contains(exe, F.lit("explorer.exe"))
    return {}, {
        "exe_name_length": F.length(exe),
        "exe_is_common_binary": t.flag(exe.isin(*v.COMMON_BINARIES)),
        "parent_exe_name_length": F.length(parent),
        "suspicious_parent_child": t.flag(both & pair_seen(v.SUSPICIOUS_PAIRS)),
        "explorer_from_userinit": t.flag(
            both & F.contains(parent, F.lit("userinit.exe")) & explorer),
        "explorer_unusual_parent": t.flag(both & explorer & ~parent.isin(*v.EXPLORER_PARENTS)),
        "system_binary_from_explorer": t.flag(
            both & explorer_parent & t.contains_any(exe, v.EXPLORER_CHILDREN)),
        "wmiprvse_unusual_parent": t.flag(
            both & F.contains(exe, F.lit("wmiprvse.exe"))
            & ~F.contains(parent, F.lit("svchost.exe"))),
        "parent_cmdline_similarity": t.flag(
            (F.col("_cmd") != "") & (F.col("_pcmd") != "")
            & F.contains(F.col("_lc"), F.col("_pcmd"))),
    }


def embedding_rules(options: RuleOptions) -> tuple[Columns, Columns]:
    """Summary of the vector column ``embedding``; 0 where there is none."""
    vector = F.col("_vec")
    size = F.size(vector)

    def where_present(value: Column) -> Column:
        return F.when(size > 0, value).otherwise(F.lit(0.0))

    def sum_of(term) -> Column:
        return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + term(x.cast("double")))

    parts = {"_mean": where_present(sum_of(lambda x: x) / size)}
    variance = sum_of(lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))) / size
    return parts, {
        "text_embedding_mean": F.col("_mean"),
        "text_embedding_std": where_present(F.sqrt(variance)),
        "text_embedding_min": where_present(F.array_min(vector).cast("double")),
        "text_embedding_max": where_present(F.array_max(vector).cast("double")),
    }


def embedding_summary(df: DataFrame, vector_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The four summary columns of any vector column."""
    parts, features = embedding_rules(RuleOptions())
    staged = df.select(*keep, F.coalesce(F.col(vector_col), F.array()).alias("_vec"))
    staged = staged.select("*", *[c.alias(n) for n, c in parts.items()])
    return staged.select(*keep, *[c.alias(n) for n, c in features.items()])
