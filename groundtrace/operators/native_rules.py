"""Native-binary, technique, anomaly, usage and context rules (F-NATIVE, F-APT, F-ANOM, F-USE, F-CTX).

Each rule set returns two dictionaries of columns: ``parts`` (shared intermediate values, computed
once) and ``features`` (the published columns).
"""

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundtrace import vocabulary as v
from groundtrace.functions.text import (
    contains_all, contains_any, count_of, count_of_any, flag, hits,
)
from groundtrace.operators.base_fields import RuleOptions

NATIVE = ("is_native_binary", "native_binary_abuse_score", "native_binary_high_risk")
TECHNIQUE = tuple(f"apt_{t}" for t in v.TECHNIQUE_INDICATORS) + (
    "apt_lotl_score", "apt_lotl_detected", "num_apt_techniques", "high_confidence_apt")
ANOMALY = ("unusual_binary_combo", "execution_context_anomaly")
USAGE = ("binary_usage_complexity", "binary_usage_suspicious", "powershell_abuse", "wmic_abuse",
         "rundll32_abuse")
CONTEXT = ("execution_context_risk", "high_risk_context")

Columns = dict[str, Column]


def points(value: int, condition: Column) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0))


def total(*scores: Column) -> Column:
    return reduce(add, scores)


def is_native() -> Column:
    return F.col("_exe").isin(*v.NATIVE_BINARIES)


def pair_seen(pairs) -> Column:
    return reduce(or_, [F.contains(F.col("_pexe"), F.lit(p)) & F.contains(F.col("_exe"), F.lit(c))
                        for p, c in pairs])


def native_rules(options: RuleOptions) -> tuple[Columns, Columns]:
    score = total(
        points(2, F.col("_user").isin(*v.SERVICE_ACCOUNTS)),
        points(3, F.contains(F.col("_par"), F.lit("explorer.exe"))),
        points(2, (F.col("_len") > 50) & contains_any(F.col("_lc"), v.ENCODED_MARKERS)),
        points(1, (F.col("_dip") != "") | (F.col("_sport") != 0)),
    )
    parts = {"_abuse": F.when(is_native(), score).otherwise(F.lit(0))}
    return parts, {
        "is_native_binary": flag(is_native()),
        "native_binary_abuse_score": F.least(F.col("_abuse"), F.lit(10)),
        "native_binary_high_risk": flag(F.col("_abuse") >= 5),
    }


def technique_rules(options: RuleOptions) -> tuple[Columns, Columns]:
    parts = {}
    for technique, indicators in v.TECHNIQUE_INDICATORS.items():
        words = [w.lower() for w in indicators] if options.fix_case else indicators
        parts[f"_apt_{technique}"] = hits(F.col("_lc"), words)
    counts = [F.col(name) for name in parts]
    techniques = total(*[flag(c > 0) for c in counts])
    features = {f"apt_{t}": flag(F.col(f"_apt_{t}") > 0) for t in v.TECHNIQUE_INDICATORS}
    features |= {
        "apt_lotl_score": F.least(total(*counts), F.lit(10)),
        "apt_lotl_detected": flag(total(*counts) > 0),
        "num_apt_techniques": techniques,
        "high_confidence_apt": flag(techniques >= 2),
    }
    return parts, features


def anomaly_rules(options: RuleOptions) -> tuple[Columns, Columns]:
    exe, integ, user = F.col("_exe"), F.col("_integ"), F.col("_user")
    odd_context = (
        (user.isin(*v.SERVICE_ACCOUNTS) & contains_any(exe, v.INTERACTIVE_TOOLS))
        | (F.contains(user, F.lit("NETWORK SERVICE")) & contains_any(exe, v.ADMIN_TOOLS))
        | (contains_any(integ, ("low", "medium")) & exe.isin(*v.LOW_INTEGRITY_TOOLS))
    )
    return {}, {
        "unusual_binary_combo": flag(pair_seen(v.UNUSUAL_PAIRS)),
        "execution_context_anomaly": flag(odd_context),
    }


def usage_rules(options: RuleOptions) -> tuple[Columns, Columns]:
    cmd, lc, exe, length = F.col("_cmd"), F.col("_lc"), F.col("_exe"), F.col("_len")
    complexity = total(
        F.when(length > 200, F.lit(2)).when(length > 100, F.lit(1)).otherwise(F.lit(0)),
        points(1, count_of_any(cmd, "/-") > 5),
        points(1, (count_of(cmd, '"') > 4) | (count_of(cmd, "'") > 4)),
        points(1, contains_any(cmd, (">", "<", "|"))),
    )
    powershell = total(
        points(3, F.contains(lc, F.lit("-enc"))),
        points(2, contains_all(lc, "bypass", "executionpolicy")),
        points(1, contains_all(lc, "hidden", "windowstyle")),
        points(2, contains_any(lc, ("downloadstring", "downloadfile"))),
        points(2, contains_any(lc, ("iex", "invoke-expression"))),
    )
    wmic = total(
        points(3, F.contains(cmd, F.lit("/node:"))),
        points(2, contains_all(lc, "process", "create")),
        points(2, contains_any(cmd, ("/user:", "/password:"))),
    )
    rundll32 = total(
        points(3, F.contains(cmd, F.lit("javascript:"))),
        points(1, contains_any(lc, ("comsvcs.dll", "shell32.dll"))),
        points(3, F.contains(lc, F.lit("minidump"))),
    )

    def for_binary(name: str, score: Column) -> Column:
        return F.when((exe == name) & (cmd != ""), F.least(score, F.lit(5))).otherwise(F.lit(0))

    parts = {"_usage": F.when(is_native() & (cmd != ""), complexity).otherwise(F.lit(0))}
    return parts, {
        "binary_usage_complexity": F.least(F.col("_usage"), F.lit(5)),
        "binary_usage_suspicious": flag(F.col("_usage") >= 3),
        "powershell_abuse": for_binary("powershell.exe", powershell),
        "wmic_abuse": for_binary("wmic.exe", wmic),
        "rundll32_abuse": for_binary("rundll32.exe", rundll32),
    }


def context_rules(options: RuleOptions) -> tuple[Columns, Columns]:
    img = F.col("_img")
    parts = {"_ctx": total(
        points(2, contains_any(F.col("_integ"), ("system", "high"))),
        points(2, contains_any(F.col("_user"), ("SYSTEM", "NETWORK SERVICE"))),
        points(1, F.contains(F.col("_par"), F.lit("explorer.exe"))),
        points(2, ~F.contains(img, F.lit("system32")) & contains_any(img, v.INTERACTIVE_TOOLS)),
    )}
    return parts, {
        "execution_context_risk": F.least(F.col("_ctx"), F.lit(10)),
        "high_risk_context": flag(F.col("_ctx") >= 5),
    }
