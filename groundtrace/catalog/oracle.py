"""DuckDB SQL that states the result of each registered query from the tables alone.

Written against the definitions of the rules, not derived from the Spark expressions; only the fixed
lists are shared. Forests of many trees have no entry; trees of one split, whose fit SQL can state, have.
"""

import re

from groundtrace import vocabulary as v
from groundtrace.catalog import binding as b
from groundtrace.catalog.queries import STUMP, WEIGHTS
from groundtrace.operators.feature_table import FEATURES

# --- pieces of SQL ---------------------------------------------------------------------------------


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def both(column: str, one: str, two: str) -> str:
    return f"(contains({column}, {q(one)}) AND contains({column}, {q(two)}))"


def one_of(column: str, words) -> str:
    return f"({column} IN ({', '.join(q(w) for w in words)}))"


def flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def pts(points: int, condition: str) -> str:
    return f"(CASE WHEN {condition} THEN {points} ELSE 0 END)"


def cnt(column: str, *parts: str) -> str:
    return "(" + " + ".join(
        f"(length({column}) - length(replace({column}, {q(p)}, ''))) // {len(p)}" for p in parts) + ")"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def columns(items: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in items.items())


def values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else q(x) for x in row) + ")"
                     for row in rows)


# --- the process events ----------------------------------------------------------------------------

BASE = f"""WITH tpl(t, timg, tcmd, tcls) AS (VALUES {values((i, *t) for i, t in enumerate(b.TEMPLATES))}),
acc(a, usr, dom, acct) AS (VALUES {values((i, *a) for i, a in enumerate(b.ACCOUNTS))}),
par(p, pimg, pcmd) AS (VALUES {values((i, p, c) for i, (p, c) in enumerate(zip(b.PARENTS, b.PARENT_COMMANDS)))}),
itg(i, integ) AS (VALUES {values(enumerate(b.INTEGRITY))}),
tec(x, tech) AS (VALUES {values(enumerate(b.TECHNIQUES))}),
rea(x, reason) AS (VALUES {values(enumerate(b.REASONS))}),
con(x, conf) AS (VALUES {values(enumerate(b.CONFIDENCES))}),
ev AS (
  SELECT e.event_id AS event_key,
    CASE e.event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 11 ELSE 1 END AS eid,
    strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS etime, 'HOST' || (e.event_id % 40) AS host,
    CASE WHEN e.event_id % 7 <> 3 THEN timg END AS img_main,
    CASE WHEN e.event_id % 7 = 3 THEN timg END AS img_source,
    timg AS img, tcmd AS cmd, tcls AS label,
    par.pimg AS parent, par.pcmd AS pcmd, 1000 + e.event_id % 9000 AS pid,
    CASE WHEN e.event_id % 3 <> 0 THEN 400 + e.event_id % 600 END AS ppid,
    acc.usr AS usr, acc.dom AS dom, acc.acct AS acct, itg.integ AS integ,
    CASE WHEN e.event_type = 'purchase' THEN 49152 + e.event_id % 1000 END AS sport,
    CASE WHEN e.event_type = 'purchase' THEN
      CASE e.event_id % 3 WHEN 0 THEN 443 WHEN 1 THEN 80 END END AS dport,
    CASE WHEN e.event_type = 'purchase' THEN '10.0.0.' || (e.event_id % 250) END AS dip,
    CASE WHEN e.event_type = 'purchase' THEN 'tcp' END AS proto,
    tec.tech AS technique,
    e.event_id % 50 <> 0 AS judged,
    CASE WHEN e.event_id % 50 <> 0 THEN CASE WHEN e.value > 150 THEN
      CASE tcls WHEN 'benign' THEN 'malicious' ELSE 'benign' END ELSE tcls END END AS rlabel,
    CASE WHEN e.event_id % 50 <> 0 THEN rea.reason END AS reason,
    CASE WHEN e.event_id % 50 <> 0 THEN con.conf END AS conf,
    CASE WHEN e.event_id % 50 <> 0 THEN rt.tech END AS rtech
  FROM events e
  JOIN tpl ON tpl.t = e.event_id % 32
  JOIN acc ON acc.a = (e.event_id // 32) % 6
  JOIN par ON par.p = (e.event_id // 192) % 5
  JOIN itg ON itg.i = (e.event_id // 960) % 5
  JOIN tec ON tec.x = e.event_id % 4
  JOIN rea ON rea.x = (e.event_id // 8) % 4
  JOIN con ON con.x = (e.event_id // 4) % 4
  JOIN tec rt ON rt.x = (e.event_id // 16) % 4
)"""


def windows_name(path: str) -> str:
    rest = f"""regexp_replace({path}, '^(?:[\\\\/]{{2}}[^\\\\/]+[\\\\/]+[^\\\\/]+|[^\\\\/]:)', '')"""
    return f"""regexp_extract({rest}, '([^\\\\/]+)[\\\\/]*$', 1)"""


def windows_depth(path: str) -> str:
    rest = f"""regexp_replace({path}, '^(?:[\\\\/]{{2}}[^\\\\/]+[\\\\/]+[^\\\\/]+|[^\\\\/]:)', '')"""
    return (f"""(len(list_filter(regexp_split_to_array({rest}, '[\\\\/]'), lambda x: x <> ''))"""
            f""" + {flag(rx(path, '^(?:[\\\\/]|[^\\\\/]:)'))})""")


EVENTS = BASE + f""", f AS (
  SELECT *, lower(cmd) AS lc, length(cmd) AS len, lower(img) AS limg,
    {windows_name('lower(img)')} AS exe, coalesce(lower(parent), '') AS par,
    {windows_name("coalesce(lower(parent), '')")} AS pexe, coalesce(lower(pcmd), '') AS plc,
    coalesce(usr, '') AS u, upper(coalesce(usr, '')) AS uu, coalesce(dom, '') AS d,
    coalesce(lower(integ), '') AS ig
  FROM ev)"""


def from_events(items: dict[str, str], key: str = "event_key", source: str = "f", tail: str = "") -> str:
    keys = f"{key}, " if key else ""
    return f"{EVENTS} SELECT {keys}{columns(items)} FROM {source} {tail}"


# --- feature groups ----------------------------------------------------------------------------------

NATIVE = one_of("exe", v.NATIVE_BINARIES)
ABUSE = f"""(CASE WHEN {NATIVE} THEN {pts(2, one_of('u', v.SERVICE_ACCOUNTS))}
  + {pts(3, any_of('par', ['explorer.exe']))}
  + {pts(2, 'len > 50 AND ' + any_of('lc', v.ENCODED_MARKERS))}
  + {pts(1, 'dip IS NOT NULL OR sport IS NOT NULL')} ELSE 0 END)"""
native = {
    "is_native_binary": flag(NATIVE),
    "native_binary_abuse_score": f"least({ABUSE}, 10)",
    "native_binary_high_risk": flag(f"{ABUSE} >= 5"),
}


def technique_counts(fix: bool = False) -> dict[str, str]:
    return {t: "(" + " + ".join(flag(f"contains(lc, {q(w.lower() if fix else w)})") for w in words) + ")"
            for t, words in v.TECHNIQUE_INDICATORS.items()}


COUNTS = technique_counts()
ALL_HITS = "(" + " + ".join(COUNTS.values()) + ")"
TECHNIQUES_HIT = "(" + " + ".join(flag(f"{c} > 0") for c in COUNTS.values()) + ")"
technique = {f"apt_{t}": flag(f"{c} > 0") for t, c in COUNTS.items()} | {
    "apt_lotl_score": f"least({ALL_HITS}, 10)",
    "apt_lotl_detected": flag(f"{ALL_HITS} > 0"),
    "num_apt_techniques": TECHNIQUES_HIT,
    "high_confidence_apt": flag(f"{TECHNIQUES_HIT} >= 2"),
}


def pairs(rows) -> str:
    return "(" + " OR ".join(f"(contains(pexe, {q(p)}) AND contains(exe, {q(c)}))" for p, c in rows) + ")"


anomaly = {
    "unusual_binary_combo": flag(pairs(v.UNUSUAL_PAIRS)),
    "execution_context_anomaly": flag(
        f"({one_of('u', v.SERVICE_ACCOUNTS)} AND {any_of('exe', ['cmd.exe', 'powershell.exe', 'wmic.exe'])})"
        f" OR (contains(u, 'NETWORK SERVICE') AND {any_of('exe', ['reg.exe', 'sc.exe', 'takeown.exe', 'icacls.exe'])})"
        f" OR ({any_of('ig', ['low', 'medium'])} AND {one_of('exe', ['reg.exe', 'sc.exe', 'wevtutil.exe'])})"),
}
USAGE = f"""(CASE WHEN {NATIVE} AND cmd <> '' THEN
  CASE WHEN len > 200 THEN 2 WHEN len > 100 THEN 1 ELSE 0 END
  + {pts(1, cnt('cmd', '/', '-') + ' > 5')}
  + {pts(1, cnt('cmd', '"') + ' > 4 OR ' + cnt('cmd', "'") + ' > 4')}
  + {pts(1, any_of('cmd', ['>', '<', '|']))} ELSE 0 END)"""


def binary_score(exe: str, *parts: str) -> str:
    return f"(CASE WHEN exe = {q(exe)} AND cmd <> '' THEN least({' + '.join(parts)}, 5) ELSE 0 END)"


usage = {
    "binary_usage_complexity": f"least({USAGE}, 5)",
    "binary_usage_suspicious": flag(f"{USAGE} >= 3"),
    "powershell_abuse": binary_score(
        "powershell.exe", pts(3, any_of("lc", ["-enc"])), pts(2, both("lc", "bypass", "executionpolicy")),
        pts(1, both("lc", "hidden", "windowstyle")),
        pts(2, any_of("lc", ["downloadstring", "downloadfile"])),
        pts(2, any_of("lc", ["iex", "invoke-expression"]))),
    "wmic_abuse": binary_score(
        "wmic.exe", pts(3, any_of("cmd", ["/node:"])), pts(2, both("lc", "process", "create")),
        pts(2, any_of("cmd", ["/user:", "/password:"]))),
    "rundll32_abuse": binary_score(
        "rundll32.exe", pts(3, any_of("cmd", ["javascript:"])),
        pts(1, any_of("lc", ["comsvcs.dll", "shell32.dll"])), pts(3, any_of("lc", ["minidump"]))),
}
RISK = f"""({pts(2, any_of('ig', ['system', 'high']))}
  + {pts(2, any_of('u', ['SYSTEM', 'NETWORK SERVICE']))} + {pts(1, any_of('par', ['explorer.exe']))}
  + {pts(2, "limg <> '' AND NOT contains(limg, 'system32') AND "
         + any_of('limg', ['cmd.exe', 'powershell.exe', 'wmic.exe']))})"""
context = {
    "execution_context_risk": f"least({RISK}, 10)",
    "high_risk_context": flag(f"{RISK} >= 5"),
}

# The patterns, with the white-space class spelt out for this engine.
PATTERNS = {
    "url_encoding": [r"(?i)%[0-9a-fA-F]{2}", r"(?i)%u[0-9a-fA-F]{4}"],
    "hex_encoding": [r"(?i)\\x[0-9a-fA-F]{2}", r"(?i)0x[0-9a-fA-F]+"],
    "base64_encoding": [r"(?i)[A-Za-z0-9+/]{20,}={0,2}"],
    "unicode_encoding": [r"(?i)\\u[0-9a-fA-F]{4}", r"(?i)&#x[0-9a-fA-F]+;"],
    "case_manipulation": [r"(?i)[A-Z]{3,}", r"(?i)[a-z]{3,}[A-Z]{3,}"],
    "whitespace_manipulation": [r"[\s\p{Z}]{3,}", r"\t+"],
    "string_concatenation": [r"""\+["']""", r"""["'][\s\p{Z}]*\+[\s\p{Z}]*["']"""],
    "environment_variables": [r"(?i)%[A-Z_]+%", r"(?i)\$\{[A-Z_]+\}"],
    "command_chaining": [r"&&", r"\|\|", r"`.*`"],
    "powershell_obfuscation": [r"(?i)-enc[\s\p{Z}]+[A-Za-z0-9+/=]+", r"(?i)-e[\s\p{Z}]+[A-Za-z0-9+/=]+",
                               r"(?i)\[char\]", r"(?i)\.Replace\("],
    "javascript_obfuscation": [r"(?i)javascript:", r"(?i)eval\(", r"(?i)String\.fromCharCode\("],
    "cmd_obfuscation": [r"(?i)cmd[\s\p{Z}]+/c[\s\p{Z}]+/c", r"(?i)^[^a-zA-Z0-9\s\p{Z}/\\-]+"],
}


def statistics(c: str) -> dict[str, str]:
    alnum = f"length(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
    special = f"length(regexp_replace({c}, '[\\p{{L}}\\p{{N}}\\s\\p{{Z}}]', '', 'g'))"
    return {
        "cmdline_length": f"length({c})",
        "cmdline_ratio_alphanumeric":
            f"round(CASE WHEN length({c}) > 0 THEN {alnum} / length({c}) ELSE 0.0::DOUBLE END, 6)",
        "cmdline_ratio_special":
            f"round(CASE WHEN length({c}) > 0 THEN {special} / length({c}) ELSE 0.0::DOUBLE END, 6)",
        "num_suspicious_chars": cnt(c, "$", "@", "#", "!", "^", "&", "*"),
        "encoding_indicators": cnt(c, "%", "\\", "x", "u", "0"),
        "nested_quotes": f"greatest(0, {cnt(c, chr(39), chr(34), chr(96))} - 2)",
        "nested_brackets": "(" + " + ".join(
            f"abs({cnt(c, o)} - {cnt(c, e)})" for o, e in ("()", "[]", "{}")) + ")",
        "command_chains": cnt(c, "&&", "||", ";", "|"),
    }


def pattern_hits(c: str) -> dict[str, str]:
    return {k: "(" + " + ".join(flag(rx(c, p)) for p in ps) + ")" for k, ps in PATTERNS.items()}


def entropy_of(source: str, key: str, text: str) -> str:
    """Entropy per key by counting characters; 0 for empty text."""
    return f"""ch AS (SELECT {key} AS k, unnest(string_split({text}, '')) AS c FROM {source}),
    cc AS (SELECT k, c, count(*)::DOUBLE AS n FROM ch WHERE c <> '' GROUP BY k, c),
    ct AS (SELECT k, sum(n) AS total FROM cc GROUP BY k),
    ent AS (SELECT cc.k, -sum(n / total * log2(n / total)) AS h FROM cc JOIN ct USING (k) GROUP BY cc.k)"""


HITS = pattern_hits("cmd")
MATCHED = "(" + " + ".join(f"h_{k}" for k in HITS) + ")"
CATEGORIES = "(" + " + ".join(flag(f"h_{k} > 0") for k in HITS) + ")"
obfuscation = {f"obfuscation_{k}": flag(f"h_{k} > 0") for k in HITS} | {
    "cmdline_entropy": "round(h, 6)", "high_entropy": flag("h > 4.5"),
} | statistics("cmd") | {
    "powershell_obfuscation": f"""(CASE WHEN {any_of('lc', ['powershell', 'pwsh'])} THEN least(
      {pts(2, rx('cmd', '-enc[' + chr(92) + 's' + chr(92) + 'p{Z}]+[A-Za-z0-9+/=]{20,}'))}
      + {pts(1, "contains(lc, '[char]') OR contains(cmd, 'String.fromCharCode')")}
      + {pts(1, cnt('lc', '.replace(') + ' > 2')}
      + {pts(1, any_of('lc', ['iex', 'invoke-expression']))}
      + {pts(1, any_of('lc', ['downloadstring', 'downloadfile']))}, 5) ELSE 0 END)""",
    "obfuscation_score": f"round(least({MATCHED} * 0.1::DOUBLE + h / 10, 1), 6)",
    "num_obfuscation_patterns": CATEGORIES,
    "obfuscation_intensity": f"round(least({CATEGORIES} * 0.2::DOUBLE + h / 5, 1), 6)",
}
WITH_PATTERNS = f""", cmds AS (SELECT DISTINCT cmd FROM f),
    {entropy_of('cmds', 'cmd', 'cmd')},
    g AS (SELECT f.*, coalesce(ent.h, 0.0) AS h, {columns({'h_' + k: s for k, s in HITS.items()})}
          FROM f LEFT JOIN ent ON ent.k = f.cmd)"""


def from_patterns(items: dict[str, str], tail: str = "", key: str = "event_key") -> str:
    keys = f"{key}, " if key else ""
    return f"{EVENTS}{WITH_PATTERNS} SELECT {keys}{columns(items)} FROM g {tail}"


HOUR = "CAST(regexp_extract(etime, '([0-9]{2}):[0-9]{2}:[0-9]{2}', 1) AS INTEGER)"
event = {
    "event_id": "eid", "is_process_create": flag("eid = 1"),
    "is_network_connection": flag("eid = 3"), "is_file_create": flag("eid = 11"),
    "integrity_level_encoded":
        "(CASE ig WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'system' THEN 4 ELSE 0 END)",
    "is_low_integrity": flag("contains(ig, 'low')"),
    "is_high_integrity": flag(any_of("ig", ["high", "system"])),
    "is_system_user": flag(any_of("uu", ["SYSTEM", "NT AUTHORITY"])),
    "is_network_service": flag("contains(uu, 'NETWORK SERVICE')"),
    "has_domain": flag("d <> ''"), "user_length": "length(u)", "domain_length": "length(d)",
    "system_account_admin_tool": flag("contains(uu, 'NETWORK SERVICE') AND " + any_of(
        "limg", ["reg.exe", "sc.exe", "takeown.exe", "icacls.exe", "cmd.exe"])),
    "process_id": "pid", "parent_process_id": "coalesce(ppid, 0)",
    "has_parent": flag("coalesce(ppid, 0) <> 0"), "event_hour": HOUR,
    "is_off_hours": flag(f"{HOUR} < 6 OR {HOUR} > 22"),
    "has_network_activity": flag("sport IS NOT NULL"),
    "source_port": "coalesce(sport, 0)", "destination_port": "coalesce(dport, 0)",
}


def has(words) -> str:
    return flag(any_of("lc", words))


def path_flags(fix: bool = False) -> dict[str, str]:
    def listed(paths):
        return [p.replace("\\\\", "\\") for p in paths] if fix else paths

    return {"suspicious_path_operation": has(listed(v.SUSPICIOUS_PATHS)),
            "system_file_modification": has(listed(v.SYSTEM_FILES))}


command = {
    "cmdline_word_count":
        "len(list_filter(regexp_split_to_array(cmd, '[\\s\\p{Z}]+'), lambda x: x <> ''))",
    "cmdline_char_count": "len",
    "is_system32_binary": flag("contains(limg, 'system32')"),
    "is_syswow64_binary": flag("contains(limg, 'syswow64')"),
    "is_windows_binary": flag("contains(limg, 'windows')"),
    "is_temp_binary": flag(any_of("limg", ["temp", "appdata"])),
    "image_path_depth": windows_depth("img"),
    "parent_is_explorer": flag("contains(par, 'explorer.exe')"),
    "parent_is_system": flag("contains(par, 'system')"),
    "parent_is_svchost": flag("contains(par, 'svchost.exe')"),
    "has_redirection": flag(any_of("cmd", [">", "<"])), "has_piping": flag("contains(cmd, '|')"),
    "has_chaining": flag(any_of("cmd", ["&&", "||"])),
    "has_encoded_content": has(v.ENCODED_MARKERS),
    "has_quotes": flag(any_of("cmd", ['"', "'"])), "num_quotes": cnt("cmd", '"', "'"),
    "num_slashes": cnt("cmd", "/", "\\"), "num_dashes": cnt("cmd", "-"), "num_equals": cnt("cmd", "="),
    "is_powershell": has(["powershell", "pwsh"]),
    "has_powershell_bypass": flag(both("lc", "bypass", "executionpolicy")),
    "has_network_cmd": has(v.NETWORK_COMMANDS), "has_file_ops": has(v.FILE_COMMANDS),
    "has_registry_ops": has(v.REGISTRY_COMMANDS), "has_service_ops": has(v.SERVICE_COMMANDS),
    **path_flags(),
    "compression_operation": has(v.COMPRESSION_COMMANDS),
    "process_discovery": has(v.PROCESS_DISCOVERY_COMMANDS),
    "network_discovery": has(v.NETWORK_DISCOVERY_COMMANDS),
}
TWO = "limg <> '' AND par <> '' AND "
relation = {
    "exe_name_length": "length(exe)", "exe_is_common_binary": flag(one_of("exe", v.COMMON_BINARIES)),
    "parent_exe_name_length": "length(pexe)",
    "suspicious_parent_child": flag(TWO + pairs(v.SUSPICIOUS_PAIRS)),
    "explorer_from_userinit": flag(TWO + "contains(pexe, 'userinit.exe') AND contains(exe, 'explorer.exe')"),
    "explorer_unusual_parent": flag(
        TWO + "contains(exe, 'explorer.exe') AND pexe NOT IN ('winlogon.exe', 'userinit.exe', 'explorer.exe')"),
    "system_binary_from_explorer": flag(TWO + "contains(pexe, 'explorer.exe') AND " + any_of(
        "exe", ["cmd.exe", "powershell.exe", "wmic.exe", "reg.exe", "sc.exe"])),
    "wmiprvse_unusual_parent": flag(
        TWO + "contains(exe, 'wmiprvse.exe') AND NOT contains(pexe, 'svchost.exe')"),
    "parent_cmdline_similarity": flag("cmd <> '' AND plc <> '' AND contains(lc, plc)"),
}
NO_VECTOR = {f"text_embedding_{n}": "0.0::DOUBLE" for n in ("mean", "std", "min", "max")}
EVERYTHING = native | technique | anomaly | usage | context | obfuscation | event | command | NO_VECTOR

# Entropies enter the sums unrounded.
UNROUNDED = EVERYTHING | {
    "cmdline_entropy": "h", "obfuscation_score": f"least({MATCHED} * 0.1::DOUBLE + h / 10, 1)",
    "obfuscation_intensity": f"least({CATEGORIES} * 0.2::DOUBLE + h / 5, 1)",
    "cmdline_ratio_alphanumeric":
        "CASE WHEN len > 0 THEN length(regexp_replace(cmd, '[^\\p{L}\\p{N}]', '', 'g')) / len ELSE 0.0::DOUBLE END",
    "cmdline_ratio_special":
        "CASE WHEN len > 0 THEN length(regexp_replace(cmd, '[\\p{L}\\p{N}\\s\\p{Z}]', '', 'g')) / len ELSE 0.0::DOUBLE END",
}
CONFIDENCE = "(CASE lower(coalesce(conf, '')) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)"
RWORDS = "len(list_filter(regexp_split_to_array(reason, '\\s+'), lambda x: x <> ''))"
reason = {n: f"CASE WHEN judged THEN {flag(any_of('lower(reason)', words))} END"
          for n, words in v.REASON_WORDS.items()} | {
    "claude_confidence_encoded": f"CASE WHEN judged THEN {CONFIDENCE} END",
    "reasoning_length": "CASE WHEN judged THEN length(reason) END",
    "reasoning_word_count": f"CASE WHEN judged THEN {RWORDS} END",
    "has_attack_technique": f"CASE WHEN judged THEN {flag(chr(114) + 'tech <> ' + q(''))} END",
}
LOWER_REASON = "lower(coalesce(reason, ''))"
disagreement = {
    "cmdline_length": "len", "label_mismatch": flag("judged AND rlabel <> label"),
    "claude_confidence_encoded": CONFIDENCE,
    "reason_mentions_standard": flag(any_of(LOWER_REASON, v.DISAGREEMENT_STANDARD_WORDS)),
    "reason_mentions_suspicious": flag(any_of(LOWER_REASON, v.DISAGREEMENT_SUSPICIOUS_WORDS)),
    "reason_length": "length(coalesce(reason, ''))", "has_attack_technique": flag("technique <> ''"),
    "disagreement_explorer_userinit": flag(
        TWO + "contains(pexe, 'userinit.exe') AND contains(exe, 'explorer.exe')"),
    "disagreement_system_account": flag(TWO + any_of("uu", ["SYSTEM", "NETWORK SERVICE"])),
    "disagreement_compression": has(v.DISAGREEMENT_COMPRESSION),
    "disagreement_discovery": has(v.DISAGREEMENT_DISCOVERY),
}

# --- verdicts, outcomes, metrics ----------------------------------------------------------------------

ENCODED, BYPASS = any_of("lc", ["-enc", "encoded"]), both("lc", "bypass", "executionpolicy")
THREE = one_of("exe", ["cmd.exe", "powershell.exe", "wmic.exe"])
HSCORE = (f"({pts(2, ENCODED)} + {pts(2, BYPASS)} + {pts(2, any_of('cmd', ['/node:']))}"
          f" + {pts(1, any_of('cmd', ['%', chr(92) + 'x']))} + {pts(1, THREE)})")
JUDGED = f""", j AS (SELECT *, {HSCORE} AS hscore,
    CASE WHEN {HSCORE} >= 2 THEN 'malicious' ELSE 'benign' END AS prediction,
    coalesce(rlabel, 'benign') AS rpred FROM f)"""
REASONS = f"""CASE WHEN prediction = 'malicious' THEN
  coalesce(nullif(concat_ws('. ', CASE WHEN {THREE} THEN {q(v.REASON_NATIVE)} || exe END,
    CASE WHEN {ENCODED} THEN {q(v.REASON_ENCODED)} END,
    CASE WHEN {BYPASS} THEN {q(v.REASON_BYPASS)} END,
    CASE WHEN contains(cmd, '/node:') THEN {q(v.REASON_REMOTE)} END,
    CASE WHEN {any_of('cmd', ['%', chr(92) + 'x', '0x'])} THEN {q(v.REASON_OBFUSCATION)} END,
    CASE WHEN {any_of('uu', ['SYSTEM', 'NT AUTHORITY'])} THEN {q(v.REASON_SYSTEM)} END), ''),
    {q(v.REASON_MALICIOUS_FALLBACK)})
  ELSE coalesce(nullif(concat_ws('. ',
    CASE WHEN {any_of('lc', ['dir', 'cd', 'type', 'echo'])} THEN {q(v.REASON_ADMIN)} END,
    CASE WHEN {any_of("coalesce(integ, '')", ['Medium', 'High'])} THEN {q(v.REASON_INTEGRITY)} || integ END),
    ''), {q(v.REASON_BENIGN_FALLBACK)}) END"""
OUTCOME = """CASE WHEN rpred = label AND prediction <> label THEN 'reviewer_only'
  WHEN prediction = label AND rpred <> label THEN 'model_only'
  WHEN rpred = label AND prediction = label THEN 'both' ELSE 'neither' END"""


def cells(truth: str, called: str, prefix: str = "") -> str:
    def n(t: str, c: str) -> str:
        return f"count(*) FILTER (WHERE {truth} = '{t}' AND {called} = '{c}')"

    return (f"{n('malicious', 'malicious')} AS {prefix}tp, {n('benign', 'malicious')} AS {prefix}fp, "
            f"{n('benign', 'benign')} AS {prefix}tn, {n('malicious', 'benign')} AS {prefix}fn")


def share(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} > 0 THEN ({top})::DOUBLE / ({bottom}) ELSE 0.0 END"


def measures(p: str = "", digits: int | None = 6) -> str:
    parts = {
        "accuracy": share(f"{p}tp + {p}tn", f"{p}tp + {p}fp + {p}tn + {p}fn"),
        "precision": share(f"{p}tp", f"{p}tp + {p}fp"), "recall": share(f"{p}tp", f"{p}tp + {p}fn"),
        "f1": share(f"2 * {p}tp", f"2 * {p}tp + {p}fp + {p}fn"),
    }
    if digits is not None:
        parts = {k: f"round({s}, {digits})" for k, s in parts.items()}
    return ", ".join(f"{s} AS {p}{k}" for k, s in parts.items())


DOCS = """WITH d AS (SELECT doc_id AS event_key,
  CASE quality WHEN 0 THEN 'benign' WHEN 1 THEN 'malicious' END AS label,
  CASE toxic WHEN 0 THEN 'benign' WHEN 1 THEN 'malicious' END AS prediction FROM labels)"""


def in_order(seed: int, key: str, salt: str = "") -> str:
    return f"md5('{seed}:{salt + ':' if salt else ''}' || {key}::VARCHAR), {key}::VARCHAR"


def uniform(seed: int, key: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{seed}:{salt}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


FOLDS = f", n AS (SELECT *, ntile(5) OVER (PARTITION BY label ORDER BY {in_order(42, 'event_key')}) AS fold FROM j)"
REPORT = f"""{DOCS}, c AS (SELECT {cells('label', 'prediction')} FROM d),
 r AS (SELECT 'benign' AS "row", tn AS h, fn AS x, fp AS m, tp + tn AS ok FROM c
       UNION ALL SELECT 'malicious', tp, fp, fn, tp + tn FROM c),
 s AS (SELECT "row", {share('h', 'h + x')} AS "precision", {share('h', 'h + m')} AS recall,
       {share('2 * h', '2 * h + x + m')} AS f1, h + m AS support, ok FROM r),
 a AS (SELECT "row", "precision", recall, f1, support FROM s
   UNION ALL SELECT 'accuracy', any_value(ok) / sum(support), any_value(ok) / sum(support),
     any_value(ok) / sum(support), sum(support) FROM s
   UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), sum(support) FROM s
   UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support),
     sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s)
 SELECT "row", round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1,
   support::BIGINT AS support FROM a"""


def first_word(words, *texts: str) -> str:
    tests = " ".join(
        f"WHEN {' OR '.join(f'contains({x}, {q(w)})' for x in texts)} THEN {q(w)}" for w in words)
    return f"(CASE {tests} END)"


HIDDEN = first_word(v.FAILURE_OBFUSCATION, "lc")
ACCOUNT = "lower(coalesce(nullif(usr, ''), acct, ''))"
ADMIN = (f"({any_of('lc', v.FAILURE_ADMIN)} AND ({any_of(ACCOUNT, ['admin', 'svc', 'it'])}"
         f" OR ends_with({ACCOUNT}, '$')))")
NOVEL = (f"(CASE WHEN limg <> '' AND NOT {one_of('limg', v.FAILURE_KNOWN_IMAGES)} THEN "
         f"{first_word(v.FAILURE_NOVEL, 'lc', 'limg')} END)")


def evidence(template: str, word: str) -> str:
    before, after = template.split("%s")
    return f"{q(before)} || {word} || {q(after)}"


PATTERN = f"""CASE WHEN {HIDDEN} IS NOT NULL THEN {q(v.SUBTLE_OBFUSCATION)} WHEN {ADMIN} THEN
  {q(v.CONTEXT_LEGITIMATE)} WHEN {NOVEL} IS NOT NULL THEN {q(v.NOVEL_TECHNIQUE)} ELSE {q(v.UNMAPPED)} END"""
EVIDENCE = f"""CASE WHEN {HIDDEN} IS NOT NULL THEN {evidence(v.EVIDENCE_OBFUSCATION, HIDDEN)}
  WHEN {ADMIN} THEN {q(v.EVIDENCE_ADMIN)} WHEN {NOVEL} IS NOT NULL THEN
  {evidence(v.EVIDENCE_NOVEL, NOVEL)} ELSE {q(v.EVIDENCE_UNMAPPED)} END"""
PROMPT = """concat_ws(' | ', '[' || etime || ']', 'PID=' || pid, 'User=' || usr, 'Image=' || img,
  CASE WHEN cmd <> '' THEN 'CMD=' || cmd END)"""

# --- contributions with fixed weights -------------------------------------------------------------------

PLACES = {n: i for i, n in enumerate(WEIGHTS)}
LONG = " UNION ALL ".join(
    f"SELECT event_key, {i} AS place, '{n}' AS feature, {n}::DOUBLE AS value, {WEIGHTS[n]}::DOUBLE AS w FROM x"
    for n, i in PLACES.items())
CONTRIBUTIONS = f"""{EVENTS}{JUDGED}, cmds AS (SELECT DISTINCT cmd FROM f),
  {entropy_of('cmds', 'cmd', 'cmd')},
  g AS (SELECT j.*, coalesce(ent.h, 0.0) AS h, {columns({'h_' + k: s for k, s in HITS.items()})}
        FROM j LEFT JOIN ent ON ent.k = j.cmd),
  x AS (SELECT event_key, {columns({n: UNROUNDED[n] for n in WEIGHTS})} FROM g),
  l AS ({LONG}),
  s AS (SELECT place, avg(value) AS m, stddev_pop(value) AS sd FROM l GROUP BY place),
  c AS (SELECT event_key, l.place, feature, value,
          (value - m) / (CASE WHEN sd > 1e-12 * greatest(1, abs(m)) THEN sd ELSE 1 END) * w AS contribution
        FROM l JOIN s USING (place)),
  t AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY abs(contribution) DESC, place DESC) AS rank
        FROM c QUALIFY rank <= 5)"""
EXACT = "CASE feature " + " ".join(
    f"WHEN {q(k)} THEN {q(a)}" for k, a in v.ATTACK_TYPES.items()) + " END"
PART = "CASE " + " ".join(
    f"WHEN contains(feature, {q(k)}) THEN {q(a)}" for k, a in v.ATTACK_TYPES.items()) + " END"
KIND = f"coalesce({EXACT}, {PART})"
ATTACK = f""", k AS (SELECT event_key, {KIND} AS kind, sum(abs(contribution)) AS total, min(rank) AS seen
    FROM t WHERE {KIND} IS NOT NULL AND contribution <> 0 GROUP BY event_key, kind),
  best AS (SELECT event_key, arg_max(kind, (total, -seen)) AS attack_type FROM k GROUP BY event_key)"""
DRIVERS = """, up AS (SELECT event_key, feature, rank, contribution > 0 AS pos,
    row_number() OVER (PARTITION BY event_key, contribution > 0 ORDER BY rank) AS no
    FROM t WHERE contribution <> 0 QUALIFY no <= 3),
  names AS (SELECT event_key, string_agg(feature, ', ' ORDER BY rank) FILTER (WHERE pos) AS a,
    string_agg(feature, ', ' ORDER BY rank) FILTER (WHERE NOT pos) AS b FROM up GROUP BY event_key)"""
NUMBER = """CASE WHEN abs(value) < 0.001 THEN '0' WHEN abs(value) < 1 THEN format('{:.3f}', value)
  ELSE format('{:.2f}', value) END"""
SIZE = "CASE WHEN abs(contribution) >= 0.001 THEN format('{:.3f}', contribution) ELSE '0.000' END"


def spoken(title: str, text: str) -> str:
    return f"'**' || {title} || '** (value: ' || {NUMBER} || ', SHAP: ' || {SIZE} || '): ' || {text}"


def title_case(feature: str) -> str:
    return " ".join(w.capitalize() for w in feature.split("_"))


def filled(template: str, feature: str, key: str) -> str:
    """A sentence template as a SQL expression."""
    kind = feature.replace(key, "").replace("_", " ")
    known = {"exe": f"CASE WHEN img <> '' THEN {windows_name('img')} ELSE 'system binary' END", "user": "coalesce(usr, 'N/A')",
             "kind": q(kind), "kind:title": q(" ".join(w.capitalize() for w in kind.split(" "))), "dim": q(feature.rsplit("_", 1)[-1])}
    parts = re.split(r"\{([^}]*)\}", template)
    return " || ".join(f"({known[x]})" if i % 2 else q(x) for i, x in enumerate(parts) if x)


def sentences(feature: str) -> str:
    """The sentence of one feature: the first rule whose key its name holds, else the general one."""
    cases = []
    for how, key, title, text in v.SENTENCES:
        if not (feature.startswith(key) if how == "prefix" else key in feature):
            continue
        if how == "entropy":
            cases.append(("value > 4.5", spoken(*[q(x) for x in v.HIGH_ENTROPY_SENTENCE])))
            cases.append(("true", spoken(*[q(x) for x in v.NORMAL_ENTROPY_SENTENCE])))
        else:
            cases.append(("value > 0", spoken(filled(title, feature, key), filled(text, feature, key))))
    if feature.startswith("text_embedding_"):
        cases += [("true", spoken(filled(title, feature, part), q(text))) for part, title, text in v.EMBEDDING_SENTENCES if part in feature]
    general = f"CASE WHEN contribution > 0 AND prediction = 'malicious' THEN {q(v.FALLBACK_MALICIOUS)} ELSE {q(v.FALLBACK_BENIGN)} END"
    cases.append(("true", spoken(q(title_case(feature)), general)))
    return " ".join(f"WHEN feature = '{feature}' AND {test} THEN {text}" for test, text in cases)


SENTENCE = "CASE " + " ".join(map(sentences, WEIGHTS)) + " END"
EXPLAINED = f"""{CONTRIBUTIONS}{ATTACK},
  lines AS (SELECT t.event_key, string_agg(rank || '. ' || {SENTENCE}, chr(10) ORDER BY rank) AS txt
    FROM t JOIN j ON j.event_key = t.event_key GROUP BY t.event_key)
  SELECT j.event_key, 'This event is classified as **' || prediction || '** with '
    || format('{{:.0f}}', least(0.5::DOUBLE + hscore * 0.1::DOUBLE, 0.99::DOUBLE) * 100) || '% confidence.'
    || chr(10) || CASE WHEN prediction = 'malicious' THEN '**Attack Type**: '
       || coalesce(attack_type, 'attack type uncertain') || chr(10) || chr(10)
       || '**Top Contributing Features:**' ELSE chr(10) || '**Key Indicators (Top Features):**' END
    || chr(10) || chr(10) || txt AS explanation
  FROM j JOIN lines USING (event_key) LEFT JOIN best ON best.event_key = j.event_key"""

# --- augmentation ----------------------------------------------------------------------------------------

KEY = "event_key::VARCHAR"
SPLIT_WORDS = "list_filter(regexp_split_to_array(cmd, '[\\s\\p{Z}]+'), lambda x: x <> '')"
SHOUTED = (f"array_to_string(list_transform({SPLIT_WORDS}, lambda w, i: CASE WHEN "
           f"(('0x' || substr(md5('42:word:' || {KEY} || '#' || (i - 1)), 1, 8))::BIGINT / 4294967296.0) < 0.2 "
           f"THEN upper(w) ELSE w END), ' ')")
SQUEEZED = (f"regexp_replace(cmd, '[\\s\\p{{Z}}]+', ' ', 'g') || "
            f"CASE WHEN {uniform(42, KEY, 'trail')} < 0.1 THEN ' ' ELSE '' END")
WAY = f"floor({uniform(42, KEY, 'technique')} * 4)"


def flipped(column: str) -> str:
    return (f"CASE WHEN {column} IS NOT NULL AND {WAY} = 1 AND {uniform(42, KEY, 'path')} < 0.1 "
            f"THEN replace(img, chr(92), '/') ELSE {column} END")


AUGMENTED = f"""{EVENTS}, o AS (SELECT *, row_number() OVER (ORDER BY {in_order(42, 'event_key', 'augment')}) AS r,
    count(*) OVER () AS n FROM f)
  SELECT event_key, label, 0 AS augmented, nullif(cmd, '') AS CommandLine, img_main AS Image,
    img_source AS SourceImage FROM o
  UNION ALL SELECT event_key, label, 1,
    CASE WHEN {WAY} = 0 AND cmd <> '' AND {uniform(42, KEY, 'case')} < 0.3 THEN {SHOUTED}
      WHEN {WAY} = 2 AND cmd <> '' AND {uniform(42, KEY, 'space')} < 0.3 THEN {SQUEEZED}
      ELSE nullif(cmd, '') END, {flipped('img_main')}, {flipped('img_source')}
  FROM o WHERE r <= floor(n * 0.5::DOUBLE)"""

# The same changes for each fold's training side, under the seed of that fold.
PER_FOLD = f"""{EVENTS}{JUDGED}{FOLDS}, m AS (SELECT n.*, i AS for_fold FROM n JOIN range(1, 6) r(i) ON i <> fold),
  o AS (SELECT *, row_number() OVER (PARTITION BY for_fold ORDER BY {in_order(42, 'event_key', 'augment')}) AS r,
    count(*) OVER (PARTITION BY for_fold) AS size FROM m),
  copies AS (SELECT event_key, label, fold::INTEGER AS fold, for_fold::INTEGER AS for_fold,
    CASE WHEN {WAY} = 0 AND cmd <> '' AND {uniform(42, KEY, 'case')} < 0.3 THEN {SHOUTED}
      WHEN {WAY} = 2 AND cmd <> '' AND {uniform(42, KEY, 'space')} < 0.3 THEN {SQUEEZED}
      ELSE nullif(cmd, '') END AS CommandLine, {flipped('img_main')} AS Image, {flipped('img_source')} AS SourceImage
    FROM o WHERE r <= floor(size * 0.5::DOUBLE))""".replace("'42:augment:'", "(42 + for_fold) || ':augment:'")
for _salt in ("technique", "case", "space", "trail", "path", "word"):
    PER_FOLD = PER_FOLD.replace(f"'42:{_salt}:'", f"(42 + for_fold) || ':{_salt}:'")

LISTED_RULES = values((r, w) for r, ws in v.TECHNIQUE_INDICATORS.items() for w in ws)
Z_SELECT = ", ".join(
    f"round(({n}::DOUBLE - m_{n}) / (CASE WHEN s_{n} > 1e-12 * greatest(1, abs(m_{n})) THEN s_{n} ELSE 1 END), 4) AS {n}" for n in FEATURES)
Z_STATISTICS = ", ".join(f"avg({n}::DOUBLE) AS m_{n}, stddev_pop({n}::DOUBLE) AS s_{n}" for n in FEATURES)
DESCRIBED = values(v.FEATURE_DESCRIPTIONS.items())


def text_columns(source: str, text: str, *keys: str) -> str:
    """All columns of the obfuscation group for a text column; equal texts are taken apart once."""
    shown = {n: f"round(({UNROUNDED[n]})::DOUBLE, 4)" for n in obfuscation}
    listed = ", ".join(keys)
    return f"""WITH t AS (SELECT {listed}, coalesce({text}, '') AS cmd FROM {source}), d AS (SELECT DISTINCT cmd FROM t),
        {entropy_of('d', 'cmd', 'cmd')},
        g AS (SELECT t.*, lower(t.cmd) AS lc, length(t.cmd) AS len, coalesce(ent.h, 0.0) AS h,
          {columns({'h_' + k: s for k, s in pattern_hits('t.cmd').items()})}
          FROM t LEFT JOIN ent ON ent.k = t.cmd)
        SELECT {listed}, {columns(shown)} FROM g"""


def group_sql(items: dict[str, str]) -> str:
    return from_events(items)


ORACLE: dict[str, str] = {
    "resolve_sanitize": from_events({
        "EventID": "eid", "EventTime": "etime", "Hostname": "host", "Image": "img_main",
        "SourceImage": "img_source", "CommandLine": "nullif(cmd, '')", "ParentImage": "parent",
        "ParentCommandLine": "pcmd", "ProcessId": "pid", "ParentProcessId": "ppid", "User": "usr",
        "Domain": "dom", "AccountName": "acct", "IntegrityLevel": "integ", "SourcePort": "sport",
        "DestinationPort": "dport", "DestinationIp": "dip", "Protocol": "proto"}),
    "agreement_split": from_events({"agreed": flag("rlabel IS NOT NULL AND rlabel = label")}),
    "reviewer_labels": from_events({"label": "rlabel"}, tail="WHERE judged"),
    "event_snapshots": from_events({
        "ground_truth": "label", "command_line": "cmd", "image": "img", "user": "coalesce(usr, acct, '')",
        "parent_image": "coalesce(parent, '')"}),
    "prompt_pairs": from_events({
        "prompt": PROMPT, "response": "'Label: ' || rlabel || '. ' || reason",
        "text": f"{PROMPT} || ' <|endoftext|> ' || 'Label: ' || rlabel || '. ' || reason || ' <|endoftext|>'",
    }, tail="WHERE judged"),
    "embedding_texts": from_events({"text": """concat_ws(' | ',
        CASE WHEN cmd <> '' THEN 'Command: ' || cmd END, 'Image: ' || img, 'Parent: ' || parent,
        'User: ' || usr)"""}),
    "reviewer_disagreement_extract": from_events(
        {"reviewer_label": "rlabel", "reason": "reason", "label": "label", "technique": "technique"},
        key="", tail="WHERE rlabel IS DISTINCT FROM label"),
    "content_keys": """SELECT *, row_number() OVER (PARTITION BY event_id, ts, user_id, event_type, value, props) AS occurrence
        FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0)""",
    "native_features": group_sql(native),
    "technique_features": group_sql(technique),
    "anomaly_features": group_sql(anomaly),
    "usage_features": group_sql(usage),
    "context_features": group_sql(context),
    "obfuscation_features": from_patterns(obfuscation),
    "event_features": group_sql(event),
    "command_features": group_sql(command),
    "relation_features": group_sql(relation),
    "feature_table_totals": f"""{EVENTS}{WITH_PATTERNS},
        x AS (SELECT label, {columns({n: UNROUNDED[n] for n in FEATURES})} FROM g)
        SELECT label, count(*) AS n, {columns({n: f'round(sum({n})::DOUBLE, 3)' for n in FEATURES})}
        FROM x GROUP BY label""",
    "corrected_rule_features": from_events({
        f"apt_{t}": flag(f"{technique_counts(True)[t]} > 0")
        for t in ("lateral_movement", "defense_evasion")} | path_flags(True)),
    # Without a "/" in the path the whole path is the name, so nothing is native.
    "posix_path_features": f"""{EVENTS},
        y AS (SELECT *, regexp_extract(limg, '([^/]+)/*$', 1) AS xn, regexp_extract(par, '([^/]+)/*$', 1) AS pn FROM f)
        SELECT event_key, {flag(one_of('xn', v.NATIVE_BINARIES))} AS is_native_binary,
        0 AS native_binary_abuse_score,
        {flag(' OR '.join(f'(contains(pn, {q(p)}) AND contains(xn, {q(c)}))' for p, c in v.UNUSUAL_PAIRS))}
          AS unusual_binary_combo,
        len(list_filter(string_split(img, '/'), lambda x: x <> '')) + {flag("starts_with(img, '/')")}
          AS image_path_depth FROM y""",
    "embedding_summary": """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)
        SELECT vec_id, round(avg(x), 5) AS text_embedding_mean,
        round(stddev_pop(x), 5) AS text_embedding_std, round(min(x), 5) AS text_embedding_min,
        round(max(x), 5) AS text_embedding_max FROM u GROUP BY vec_id""",
    "reason_features": group_sql(reason),
    "disagreement_features": f"""{EVENTS}{WITH_PATTERNS} SELECT event_key,
        {columns({n: f'round(({UNROUNDED[n]})::DOUBLE, 4)' for n in FEATURES} | {n: s for n, s in disagreement.items() if n not in FEATURES})}
        FROM g""",
    "entropy_documents": f"""WITH {entropy_of('documents', 'doc_id', 'text')}
        SELECT doc_id, round(coalesce(h, 0.0), 6) AS entropy
        FROM documents LEFT JOIN ent ON ent.k = doc_id""",
    "conversation_text_statistics": text_columns("conversations", "text", "conv_id", "turn"),
    "url_obfuscation": text_columns("pages", "url", "page_id"),
    "document_obfuscation": text_columns("documents", "text", "doc_id"),
    "page_obfuscation": text_columns("pages", "html", "page_id"),
    "rule_hits_long": f"""{EVENTS}, r(rule, indicator) AS (VALUES {LISTED_RULES})
        SELECT event_key, rule, indicator FROM f JOIN r ON contains(lc, indicator)""",
    "rule_table_hits": """WITH r AS (
          SELECT DISTINCT rule, trim(part) AS indicator FROM (
            SELECT item_id::VARCHAR AS rule, unnest(string_split(lower(text), '.')) AS part FROM benchmark)
          WHERE trim(part) <> ''),
        c AS (
          SELECT 'd' || doc_id AS event_key, lower(coalesce(text, '')) AS lc FROM documents
          UNION ALL SELECT concat_ws('-', 'c', conv_id, turn), lower(coalesce(text, '')) FROM conversations)
        SELECT event_key, rule, indicator FROM c JOIN r ON contains(lc, indicator)""",
    "technique_summary": f"""{EVENTS}, x AS (SELECT label, {columns(technique)} FROM f)
        SELECT label, count(*) AS events, sum(apt_lotl_score)::BIGINT AS indicator_hits,
        sum(apt_lotl_detected)::BIGINT AS detected, sum(high_confidence_apt)::BIGINT AS high_confidence
        FROM x GROUP BY label""",
    "label_distribution": f"""{EVENTS} SELECT label, count(*) AS n,
        round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM f GROUP BY label""",
    "class_weights": f"""{DOCS} SELECT label, count(*) AS n,
        round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM d GROUP BY label""",
    "stratified_holdout": f"""{DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY label
        ORDER BY {in_order(42, 'event_key')}) AS no, count(*) OVER (PARTITION BY label) AS n FROM d)
        SELECT event_key, label, CASE WHEN no <= floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS part
        FROM r""",
    "unstratified_holdout": f"""WITH r AS (SELECT event_id AS event_key,
        row_number() OVER (ORDER BY {in_order(7, 'event_id')}) AS no, count(*) OVER () AS n FROM events)
        SELECT event_key, CASE WHEN no <= floor(n * (1 - 0.3::DOUBLE)) THEN 'train' ELSE 'test' END AS part
        FROM r""",
    "stratified_kfold": f"{EVENTS}{JUDGED}{FOLDS} SELECT event_key, label, fold::INTEGER AS fold FROM n",
    "order_folds": f"""SELECT o_orderkey, o_orderstatus, (ntile(5) OVER (PARTITION BY o_orderstatus
        ORDER BY {in_order(42, 'o_orderkey')}))::INTEGER AS fold FROM orders""",
    "hash_folds": f"""SELECT doc_id AS event_key,
        (floor({uniform(42, 'doc_id::VARCHAR', 'fold')} * 5) + 1)::INTEGER AS fold FROM labels""",
    "confusion_metrics":
        f"{DOCS}, c AS (SELECT {cells('label', 'prediction')} FROM d) SELECT *, {measures()} FROM c",
    "class_report": REPORT,
    "fold_metrics": f"""{EVENTS}{JUDGED}{FOLDS},
        c AS (SELECT fold::INTEGER AS fold, {cells('label', 'prediction')} FROM n GROUP BY fold)
        SELECT *, {measures()} FROM c""",
    "fold_metrics_mean_std": f"""{EVENTS}{JUDGED}{FOLDS},
        c AS (SELECT fold, {cells('label', 'prediction')} FROM n GROUP BY fold),
        m AS (SELECT {measures(digits=None)} FROM c)
        SELECT round(avg(accuracy), 6) AS accuracy, round(avg("precision"), 6) AS "precision",
        round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(stddev_pop(f1), 6) AS f1_std FROM m""",
    "outcome_quadrants":
        f"{EVENTS}{JUDGED} SELECT {OUTCOME} AS outcome, count(*) AS n FROM j GROUP BY outcome",
    "prediction_disagreements": f"""{EVENTS}{JUDGED} SELECT event_key, label AS ground_truth,
        rpred AS reviewer_prediction, prediction AS model_prediction,
        {flag('rpred = label')} AS reviewer_correct, {flag('prediction = label')} AS model_correct,
        technique AS attack_technique, coalesce(reason, '') AS reviewer_reason,
        nullif(cmd, '') AS command FROM j WHERE rpred <> prediction""",
    "disagreement_by_technique": f"""{EVENTS}{JUDGED} SELECT technique AS attack_technique, count(*) AS n
        FROM j WHERE rpred <> prediction GROUP BY technique""",
    "top5_cases_per_technique": f"""{EVENTS}{JUDGED} SELECT technique AS attack_technique,
        (row_number() OVER (PARTITION BY technique ORDER BY event_key))::INTEGER AS case_no, event_key,
        label AS ground_truth FROM j WHERE rpred <> prediction QUALIFY case_no <= 5""",
    "misclassified": f"""{EVENTS}{JUDGED} SELECT event_key, label AS true_label,
        prediction AS predicted_label, substr(cmd, 1, 100) AS command_preview
        FROM j WHERE label <> prediction""",
    "model_and_reviewer_metrics": f"""{EVENTS}{JUDGED}, c AS (SELECT {cells('label', 'rpred', 'reviewer_')},
        {cells('label', 'prediction', 'model_')} FROM j)
        SELECT *, {measures('reviewer_')}, {measures('model_')} FROM c""",
    "failure_patterns": from_events({"failure_pattern": PATTERN, "evidence": EVIDENCE}),
    "failure_pattern_counts": f"""{EVENTS}{JUDGED} SELECT {PATTERN} AS failure_pattern, count(*) AS n
        FROM j WHERE rpred = label AND prediction <> label GROUP BY failure_pattern""",
    "failure_summary": f"""{EVENTS}{JUDGED} SELECT
        count(*) FILTER (WHERE rpred = label AND prediction <> label) AS less_than,
        count(*) FILTER (WHERE rpred <> label AND prediction = label) AS better_than,
        count(*) FILTER (WHERE rpred = label AND prediction <> label) AS labeled_failures FROM j""",
    "heuristic_verdict": f"""{EVENTS}{JUDGED} SELECT event_key, hscore AS heuristic_score,
        prediction AS heuristic_verdict, {REASONS} AS heuristic_reasons FROM j""",
    "z_scores": f"""{EVENTS}{WITH_PATTERNS}, x AS (SELECT event_key, {columns({n: UNROUNDED[n] for n in FEATURES})} FROM g),
        s AS (SELECT {Z_STATISTICS} FROM x)
        SELECT event_key, {Z_SELECT} FROM x, s""",
    "timing_summary": """WITH t AS (SELECT event_type AS stage, event_id % 7 + 1 AS n, value AS ms FROM events)
        SELECT stage, count(*) AS runs, round(avg(ms), 6) AS mean_ms, round(stddev_pop(ms), 6) AS std_ms,
        min(ms) AS min_ms, max(ms) AS max_ms, round(sum(ms) / sum(n), 6) AS ms_per_row,
        round(sum(n) / (sum(ms) / 1000), 6) AS rows_per_sec FROM t GROUP BY stage""",
    "cost_comparison": """SELECT count(*) AS alerts, round(count(*) * 0.0018::DOUBLE, 4) AS reviewer_total,
        round(count(*) * 0.00006::DOUBLE, 4) AS model_total, 1800.0::DOUBLE AS reviewer_cost_per_million,
        60.0::DOUBLE AS model_cost_per_million, 1740.0::DOUBLE AS savings_per_million,
        30.0::DOUBLE AS cost_reduction_factor FROM events""",
    "best_sweep_model": f"""{EVENTS}{JUDGED},
        c AS (SELECT coalesce(integ, '') AS model_id, {cells('label', 'prediction')} FROM j GROUP BY 1)
        SELECT model_id, round({share('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM c
        ORDER BY {share('2 * tp', '2 * tp + fp + fn')} DESC, model_id LIMIT 1""",
    "keyed_predictions": f"""{EVENTS} SELECT event_key, label, toxic AS prediction
        FROM f JOIN labels ON doc_id = event_key WHERE quality <> 0""",
    "augment_sample": AUGMENTED,
    "augment_folds": f"{PER_FOLD} SELECT event_key, fold, for_fold, CommandLine, Image, SourceImage FROM copies",
    "failure_cases": f"""{EVENTS}{JUDGED} SELECT event_key, label AS ground_truth, prediction AS model_prediction,
        rpred AS reviewer_prediction, CASE WHEN rpred = label THEN {PATTERN} END AS failure_pattern,
        CASE WHEN rpred = label THEN {EVIDENCE} END AS evidence FROM j WHERE rpred <> prediction""",
    "stream_json": f"""{EVENTS}{JUDGED} SELECT event_key, hscore AS heuristic_score, prediction AS heuristic_verdict,
        NULL AS bad_line FROM j WHERE event_key % 997 <> 5
        UNION ALL SELECT NULL, NULL, NULL, left('{{"event_key":' || event_id || ',"EventID":"', 20)
        FROM events WHERE event_id % 997 = 5""",
    "single_event_latency": "SELECT 'single_event' AS stage, least(count(*), 10) AS runs, true AS ordered FROM events",
    "entropy_long_documents": f"""WITH {entropy_of('documents', 'doc_id', 'text')}
        SELECT doc_id, round(coalesce(h, 0.0), 6) AS entropy
        FROM documents LEFT JOIN ent ON ent.k = doc_id""",
    "entropy_long_pages": f"""WITH {entropy_of('pages', 'page_id', 'html')}
        SELECT page_id, round(coalesce(h, 0.0), 6) AS entropy
        FROM pages LEFT JOIN ent ON ent.k = page_id""",
    "local_contributions": f"""{CONTRIBUTIONS} SELECT event_key, rank::INTEGER AS rank, feature,
        round(value, 6) AS value, round(contribution, 6) AS contribution FROM t""",
    "drivers": f"""{CONTRIBUTIONS}{DRIVERS} SELECT event_key, concat_ws('; ', 'Key indicators: ' || a,
        'Mitigating factors: ' || b) AS drivers FROM names""",
    "attack_type": f"""{CONTRIBUTIONS}{ATTACK} SELECT f.event_key,
        coalesce(attack_type, 'attack type uncertain') AS attack_type
        FROM f LEFT JOIN best ON best.event_key = f.event_key""",
    "attack_scores": f"""{CONTRIBUTIONS} SELECT event_key, {KIND} AS attack_type,
        round(sum(abs(contribution)), 6) AS score FROM t WHERE {KIND} IS NOT NULL AND contribution <> 0
        GROUP BY ALL""",
    "explanations": EXPLAINED,
    "global_contributions": f"""{CONTRIBUTIONS}, w(name, description) AS (VALUES {DESCRIBED}),
        i AS (SELECT feature, avg(abs(contribution)) AS importance FROM c GROUP BY feature
              ORDER BY importance DESC, feature LIMIT 10)
        SELECT feature, round(importance, 6) AS importance,
        coalesce(description, {q(v.NO_DESCRIPTION)}) AS description FROM i LEFT JOIN w ON name = feature""",
    "forest_quality":
        "SELECT count(*) AS events, true AS precision_in_band, true AS recall_in_band FROM events",
    "tree_attributions": "SELECT count(*) AS events, count(*) AS additive FROM events",
}
ORACLE["stream_heuristic"] = ORACLE["heuristic_verdict"]


# A tree of one split: of all cuts between neighbouring values of all features, the one that lowers the weighted
# Gini impurity most. ``g`` numbers independent fits; the weights balance the labels of each.


def _gini(m: str, b: str) -> str:
    return f"(2.0 * ({m}) * ({b}) / nullif((({m}) + ({b})) ** 2, 0))"


def stump(train: str, names=STUMP) -> str:
    """CTEs that end in ``best``: g, feature, cut and the weights (l: below, t: all; m, b: malicious, benign)."""
    listed = " UNION ALL ".join(f"SELECT g, label, '{n}' AS feature, {n}::DOUBLE AS value FROM {train}" for n in names)
    return f"""
        w AS (SELECT g, label, sum(count(*)) OVER (PARTITION BY g) / (2.0 * count(*)) AS weight
              FROM {train} GROUP BY g, label),
        listed AS ({listed}),
        h AS (SELECT g, feature, value, coalesce(sum(weight) FILTER (WHERE label = 'malicious'), 0.0) AS m,
              coalesce(sum(weight) FILTER (WHERE label = 'benign'), 0.0) AS b
              FROM listed JOIN w USING (g, label) GROUP BY g, feature, value),
        cuts AS (SELECT g, feature, value, lead(value) OVER o AS above, sum(m) OVER o AS lm, sum(b) OVER o AS lb,
                 sum(m) OVER (PARTITION BY g, feature) AS tm, sum(b) OVER (PARTITION BY g, feature) AS tb
                 FROM h WINDOW o AS (PARTITION BY g, feature ORDER BY value)),
        best AS (SELECT g, feature, (value + above) / 2 AS cut, lm, lb, tm, tb FROM cuts WHERE above IS NOT NULL
                 QUALIFY row_number() OVER (PARTITION BY g ORDER BY round({_gini('tm', 'tb')}
                   - (lm + lb) / (tm + tb) * {_gini('lm', 'lb')}
                   - (tm - lm + tb - lb) / (tm + tb) * {_gini('tm - lm', 'tb - lb')}, 9) DESC, feature) = 1),
        leaves AS (SELECT *, lm / (lm + lb) AS pl, (tm - lm) / (tm - lm + tb - lb) AS pr, (lm + lb) / (tm + tb) AS share
                   FROM best)"""


VALUE = "CASE feature " + " ".join(f"WHEN '{n}' THEN {n}" for n in STUMP) + " END"
P_STUMP = f"(CASE WHEN {VALUE} <= cut THEN pl ELSE pr END)"
CALLED = f"CASE WHEN {P_STUMP} > 0.5 THEN 'malicious' ELSE 'benign' END"
SURE = f"greatest({P_STUMP}, 1 - {P_STUMP})"
STUMP_ROWS = f"{EVENTS}{WITH_PATTERNS}, x AS (SELECT 1 AS g, event_key, label, {columns({n: UNROUNDED[n] for n in STUMP})} FROM g)"
STUMP_ALL = f"{STUMP_ROWS}, {stump('x')}, p AS (SELECT x.*, feature, cut, pl, pr, share FROM x JOIN leaves USING (g))"
_ORDER = in_order(42, "event_key")
STUMP_FOLDS = f"""{STUMP_ROWS},
    folded AS (SELECT * EXCLUDE (g), ntile(5) OVER (PARTITION BY label ORDER BY {_ORDER}) AS fold FROM x),
    train AS (SELECT i AS g, folded.* FROM folded JOIN range(1, 6) r(i) ON i <> fold), {stump('train')},
    p AS (SELECT folded.*, feature, cut, pl, pr FROM folded JOIN leaves ON g = fold),
    j AS (SELECT fold, label, {CALLED} AS prediction FROM p)"""
ORACLE |= {
    "adam_network": f"""{STUMP_ROWS}, r AS (SELECT event_key, label, row_number() OVER (PARTITION BY label ORDER BY {_ORDER}) AS no,
        count(*) OVER (PARTITION BY label) AS n FROM x)
        SELECT event_key, label, true AS is_probability, true AS called_by_half, true AS sure_as_called
        FROM r WHERE no > floor(n * (1 - 0.2::DOUBLE))""",
    "checkpoint_sweep": f"""{EVENTS}, c AS (SELECT label, count(*) AS n FROM f GROUP BY label),
        t AS (SELECT label, n - floor(n * (1 - 0.2::DOUBLE)) AS n FROM c)
        SELECT epoch, (sum(n) FILTER (WHERE label = 'malicious'))::BIGINT AS malicious, sum(n)::BIGINT AS tested, true AS best_is_restored
        FROM t, (VALUES (5), (10)) e(epoch) GROUP BY epoch""",
    "saved_models": """SELECT model, count(*) AS events, count(*) AS equal
        FROM events, (VALUES ('network'), ('vote'), ('disagreement')) m(model) GROUP BY model""",
    "vote_is_mean": "SELECT event_id AS event_key, true AS is_mean, true AS forest_as_alone, true AS is_probability FROM events",
    "feature_table_rows": f"""{EVENTS}{WITH_PATTERNS} SELECT event_key, label,
        {columns({n: f'round(({UNROUNDED[n]})::DOUBLE, 4)' for n in FEATURES})} FROM g""",
    "stump_score": f"""{STUMP_ALL} SELECT event_key, label, {CALLED} AS prediction, round({SURE}, 6) AS confidence,
        round({P_STUMP}, 6) AS p_malicious FROM p""",
    "stump_importance": f"""{STUMP_ALL}, n(name) AS (VALUES {values([(n,) for n in STUMP])})
        SELECT name AS feature, (CASE WHEN name = feature THEN 1 ELSE 0 END)::DOUBLE AS importance FROM n, leaves""",
    "stump_top_feature": f"""{STUMP_ALL} SELECT event_key, {CALLED} AS prediction, round({P_STUMP}, 6) AS p_malicious FROM p""",
    "stump_attributions": f"""{STUMP_ALL}, n(name) AS (VALUES {values([(n,) for n in STUMP])}),
        e AS (SELECT *, share * pl + (1 - share) * pr AS base FROM p)
        SELECT event_key, name AS feature, round(base, 6) AS base_value,
        CASE WHEN name = feature THEN round({P_STUMP} - base, 6) ELSE 0.0::DOUBLE END AS contribution FROM e, n""",
    "stump_kfold": f"""{STUMP_FOLDS}, c AS (SELECT fold::INTEGER AS fold, {cells('label', 'prediction')} FROM j GROUP BY fold)
        SELECT *, {measures()} FROM c""",
    "stump_pooled": f"{STUMP_FOLDS}, c AS (SELECT {cells('label', 'prediction')} FROM j) SELECT *, {measures()} FROM c",
    "stump_holdout": f"""{STUMP_ROWS},
        dealt AS (SELECT * EXCLUDE (g), 1 AS g, row_number() OVER (PARTITION BY label ORDER BY {_ORDER})
                  <= floor(count(*) OVER (PARTITION BY label) * (1 - 0.2::DOUBLE)) AS train FROM x),
        train AS (SELECT * FROM dealt WHERE train), {stump('train')},
        p AS (SELECT dealt.*, feature, cut, pl, pr FROM dealt, leaves WHERE NOT train),
        c AS (SELECT {cells('label', 'called')} FROM (SELECT label, {CALLED} AS called FROM p))
        SELECT *, {measures()} FROM c""",
    "stump_vs_reviewer": f"""{STUMP_ALL}{JUDGED}, o AS (SELECT p.label, j.rpred, {CALLED} AS called FROM p JOIN j USING (event_key)),
        c AS (SELECT {cells('label', 'rpred', 'reviewer_')}, {cells('label', 'called', 'model_')} FROM o)
        SELECT *, {measures('reviewer_')}, {measures('model_')} FROM c""",
    "stream_stump": f"{STUMP_ALL} SELECT event_key, {CALLED} AS prediction, round({SURE}, 6) AS confidence FROM p",
}

# ---- what was written and read again, and models of one split in full ------------------------------------

ORACLE |= {
    "json_events_read_back": ORACLE["resolve_sanitize"],
    "disagreement_csv_read_back": ORACLE["reviewer_disagreement_extract"],
    "failure_files_read_back": f"""{EVENTS}{JUDGED}, c AS (
          SELECT event_key, label AS ground_truth, cmd AS command_line, img AS image, coalesce(usr, acct, '') AS "user",
            prediction AS model_prediction, rpred = label AS lost, {PATTERN} AS pattern FROM j WHERE rpred <> prediction)
        SELECT * EXCLUDE (lost, pattern), NULL AS failure_pattern, CASE WHEN lost THEN 'less_than_reviewer' ELSE 'better_than_reviewer' END AS file FROM c
        UNION ALL SELECT * EXCLUDE (lost, pattern), pattern, 'failure_patterns' FROM c WHERE lost""",
    "nested_events_read_back": f"""{EVENTS}{JUDGED} SELECT event_key, label AS ground_truth, nullif(cmd, '') AS CommandLine,
        pid AS ProcessId, usr AS "User" FROM j WHERE rpred <> prediction""",
    "validation_read_back": f"SELECT *, 'folds=5,seed=42' AS settings FROM ({ORACLE['stump_kfold']})",
    "evaluation_read_back": ORACLE["stump_holdout"],
    "first_events": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10",
    "stump_global_attributions": f"""WITH p AS ({STUMP_ALL} SELECT * FROM p), e AS (SELECT feature, avg(abs({P_STUMP} - (share * pl + (1 - share) * pr))) AS size FROM p GROUP BY feature),
        w(name, description) AS (VALUES {DESCRIBED}), n(feature) AS (VALUES {values([(n,) for n in STUMP])}),
        i AS (SELECT n.feature, coalesce(e.size, 0.0) AS importance FROM n LEFT JOIN e USING (feature))
        SELECT feature, round(importance, 6) AS importance, coalesce(description, {q(v.NO_DESCRIPTION)}) AS description
        FROM i LEFT JOIN w ON name = feature""",
    "disagreement_training": f"""{EVENTS}, d AS (SELECT event_key, (rlabel IS NULL OR rlabel <> label)::INTEGER AS differ FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY differ ORDER BY {in_order(42, 'event_key', 'negatives')}) AS no,
          sum(differ) OVER () AS n FROM d)
        SELECT event_key, differ FROM r WHERE differ = 1 OR no <= n""",
}

# The alerts of the tree, with the names of its features in order of attribution: one is not 0.
_SPOKEN = "CASE " + " ".join(map(sentences, STUMP)) + " END"
_BASE = "(share * pl + (1 - share) * pr)"
_PLACE = "CASE name " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(STUMP)) + " END"
_OWN = "CASE name " + " ".join(f"WHEN '{n}' THEN {n}" for n in STUMP) + " END"
ORACLE["stump_explanations"] = f"""{EVENTS}, p AS ({STUMP_ALL} SELECT * FROM p), n(name) AS (VALUES {values([(n,) for n in STUMP])}),
    alerts AS (SELECT *, {CALLED} AS prediction, {SURE} AS sure, {P_STUMP} AS pm FROM p WHERE {P_STUMP} > 0.5),
    a AS (SELECT event_key, prediction, sure, name, ({_OWN})::DOUBLE AS value, {_PLACE} AS place,
          CASE WHEN name = feature THEN pm - {_BASE} ELSE 0.0::DOUBLE END AS contribution FROM alerts, n),
    t AS (SELECT * EXCLUDE (name), name AS feature, row_number() OVER (PARTITION BY event_key ORDER BY abs(contribution) DESC, place) AS rank
          FROM a QUALIFY rank <= 5){ATTACK},
    lines AS (SELECT t.event_key, any_value(t.prediction) AS prediction, any_value(t.sure) AS sure,
              string_agg(rank || '. ' || {_SPOKEN}, chr(10) ORDER BY rank) AS txt
              FROM t JOIN (SELECT event_key, img, usr FROM f) f USING (event_key) GROUP BY t.event_key)
    SELECT event_key, prediction, round(sure, 6) AS confidence, 'This event is classified as **malicious** with '
      || format('{{:.0f}}', sure * 100) || '% confidence.' || chr(10) || '**Attack Type**: ' || coalesce(attack_type, 'attack type uncertain')
      || chr(10) || chr(10) || '**Top Contributing Features:**' || chr(10) || chr(10) || txt AS explanation
    FROM lines LEFT JOIN best USING (event_key)"""

# The split between "differ" (malicious) and "agree" among the training rows, over base and reviewer features.
_JUDGING = {n: s for n, s in disagreement.items() if n not in (*STUMP, "cmdline_length", "label_mismatch")}
_BOTH = [*STUMP, *_JUDGING]
_TAKEN = "CASE feature " + " ".join(f"WHEN '{n}' THEN {n}" for n in _BOTH) + " END"
ORACLE["disagreement_stump"] = f"""{EVENTS}{WITH_PATTERNS},
    x AS (SELECT 1 AS g, event_key, CASE WHEN rlabel IS NULL OR rlabel <> label THEN 'malicious' ELSE 'benign' END AS label,
          {columns({n: UNROUNDED[n] for n in STUMP} | _JUDGING)} FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {in_order(42, 'event_key', 'negatives')}) AS no,
          count(*) FILTER (WHERE label = 'malicious') OVER () AS size FROM x),
    train AS (SELECT * EXCLUDE (no, size) FROM r WHERE label = 'malicious' OR no <= size), {stump('train', _BOTH)},
    p AS (SELECT event_key, CASE WHEN {_TAKEN} <= cut THEN pl ELSE pr END AS q FROM x JOIN leaves USING (g))
    SELECT event_key, (q > 0.5)::INTEGER AS disagreement, round(q, 6) AS p_disagreement FROM p"""
ORACLE["feature_table_by_commands"] = ORACLE["feature_table_rows"]
