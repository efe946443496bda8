"""Golden values of the rules, edge inputs, plan shape."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundtrace.functions import text as t
from groundtrace.functions.paths import basename, path_depth
from groundtrace.operators.base_fields import RuleOptions
from groundtrace.operators.feature_table import FEATURES, GROUPS, feature_group, feature_table
from groundtrace.operators.reviewer_rules import reason_features

SYS = "C:\\Windows\\System32\\"
EXPLORER = "C:\\Windows\\explorer.exe"
SHIPPED = {
    50: dict(CommandLine="powershell.exe -command Compress-Archive -Path C:\\Users\\pbeesly\\Documents\\FinancialReports\\* -DestinationPath C:\\Users\\pbeesly\\AppData\\Local\\Temp\\archive.zip",
             Image=SYS + "WindowsPowerShell\\v1.0\\powershell.exe", User="DMEVALS\\pbeesly", ParentImage=EXPLORER),
    59: dict(CommandLine=EXPLORER, Image=EXPLORER, User="NT AUTHORITY\\SYSTEM", ParentImage=SYS + "userinit.exe"),
    73: dict(CommandLine="notepad.exe C:\\Windows\\System32\\drivers\\etc\\hosts", Image=SYS + "notepad.exe",
             User="WORKSTATION\\user", ParentImage=EXPLORER),
    76: dict(CommandLine="cmd.exe /c tasklist /v", Image=SYS + "cmd.exe", User="DMEVALS\\pbeesly", ParentImage=EXPLORER),
    97: dict(CommandLine="net view \\\\fileserver", Image=SYS + "cmd.exe", User="DMEVALS\\pbeesly", ParentImage=EXPLORER),
    145: dict(CommandLine="icacls C:\\Users\\Default\\AppData\\Local\\Microsoft\\Windows\\INetCache /reset /t",
              Image=SYS + "icacls.exe", User="NT AUTHORITY\\NETWORK SERVICE", ParentImage=SYS + "cmd.exe"),
}
EXPECTED = {
    50: dict(is_native_binary=1, native_binary_abuse_score=3, unusual_binary_combo=1, binary_usage_complexity=1,
             execution_context_risk=1, compression_operation=1, suspicious_path_operation=0, num_apt_techniques=0),
    59: dict(is_native_binary=0, unusual_binary_combo=0, execution_context_risk=2, is_system_user=1,
             explorer_from_userinit=1, explorer_unusual_parent=0),
    73: dict(is_native_binary=0, execution_context_risk=1, system_file_modification=0),
    76: dict(is_native_binary=1, native_binary_abuse_score=3, native_binary_high_risk=0, unusual_binary_combo=1,
             binary_usage_complexity=0, process_discovery=1),
    97: dict(is_native_binary=1, native_binary_abuse_score=3, network_discovery=1),
    145: dict(is_native_binary=1, native_binary_abuse_score=2, apt_defense_evasion=1, apt_lotl_score=1,
              high_confidence_apt=0, execution_context_anomaly=1, execution_context_risk=2,
              system_account_admin_tool=1),
}
ALL = [*FEATURES, *GROUPS["relation"][0]]


def table_of(make_events, options=RuleOptions()):
    rows = [dict(event_key=k, **e) for k, e in SHIPPED.items()]
    return {r["event_key"]: r for r in feature_table(make_events(rows), ALL, options=options).collect()}


def test_feature_list():
    assert len(FEATURES) == len(set(FEATURES)) == 103
    assert list(FEATURES) == sorted(FEATURES)
    assert {g: len(n) for g, (n, _) in GROUPS.items()} == {
        "native": 3, "technique": 10, "anomaly": 2, "usage": 5, "context": 2, "obfuscation": 26,
        "event": 21, "command": 30, "embedding": 4, "relation": 9}


def test_group_functions_return_the_declared_names(spark):
    for names, rules in GROUPS.values():
        _, features = rules(RuleOptions())
        assert set(features) == set(names)


@pytest.mark.parametrize("key", list(EXPECTED))
def test_shipped_events(make_events, key):
    row = table_of(make_events)[key]
    assert {n: row[n] for n in EXPECTED[key]} == EXPECTED[key]


def test_rule_options(make_events):
    fixed = table_of(make_events, RuleOptions(fix_paths=True))
    assert fixed[50]["suspicious_path_operation"] == 1
    assert fixed[73]["system_file_modification"] == 1
    posix = table_of(make_events, RuleOptions(path_semantics="posix"))[76]
    assert (posix["is_native_binary"], posix["native_binary_abuse_score"], posix["unusual_binary_combo"]) == (0, 0, 1)
    rows = make_events([dict(CommandLine="Invoke-Command x")])
    names = ["apt_lateral_movement"]
    assert feature_table(rows, names).first()[1] == 0
    assert feature_table(rows, names, options=RuleOptions(fix_case=True)).first()[1] == 1


# length, words, entropy, alnum, special, suspicious, encoding, chains, quotes, brackets, categories, score, intensity
GOLDEN = {
    "cmd.exe /c dir C:\\Users": (23, 4, 3.762267, 0.695652, 0.173913, 0, 2, 0, 0, 0, 1, 0.476227, 0.952453),
    "cmd.exe /c tasklist /v": (22, 4, 3.788755, 0.727273, 0.136364, 0, 1, 0, 0, 0, 1, 0.578875, 0.957751),
    "cmd /c /c echo %TEMP% && echo ${HOME} || echo `x`":
        (49, 11, 4.043409, 0.530612, 0.265306, 3, 3, 4, 0, 0, 4, 1.0, 1.0),
    "cmd.exe /c echo %41%u0041 \\x41 0xDEADBEEF \\u0041 &#x41;":
        (55, 8, 4.240540, 0.709091, 0.163636, 2, 15, 1, 0, 0, 4, 1.0, 1.0),
    "cmd.exe /c copy a.txt \\\\srv\\share\\\t   b.txt (":
        (45, 7, 4.046974, 0.6, 0.2, 0, 7, 0, 0, 1, 2, 0.704697, 1.0),
}
GOLDEN_NAMES = ["cmdline_length", "cmdline_word_count", "cmdline_entropy", "cmdline_ratio_alphanumeric",
                "cmdline_ratio_special", "num_suspicious_chars", "encoding_indicators", "command_chains",
                "nested_quotes", "nested_brackets", "num_obfuscation_patterns", "obfuscation_score",
                "obfuscation_intensity"]


def test_golden_text_values(make_events):
    rows = make_events([dict(CommandLine=c) for c in GOLDEN])
    for row, want in zip(feature_table(rows, GOLDEN_NAMES).orderBy("event_key").collect(), GOLDEN.values()):
        assert list(row)[1:] == pytest.approx(list(want), abs=1e-6)


TEXTS = ["", " ", "\t\r\n", "a", "aaaa", "a\u00a0\u00a0b", "déjà vu ß", "日本語 テスト", "x\x1cy", "😀😀 emoji",
         "q" * 3000 + " z", "a+b=c; (d) [e] {f} \"g\" 'h' `i`", "line1\nline2\r\nline3", "%41 \\x41 0x1f &#x41;"]


def test_text_functions_against_python(spark):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string")
    x = F.col("x")
    rows = frame.select(
        "x", t.entropy(x).alias("h"), t.word_count(x).alias("w"), t.alphanumeric_count(x).alias("a"),
        t.space_count(x).alias("s"), t.count_of_any(x, "\"'`").alias("q"), t.count_of(x, "aa").alias("aa"),
    ).collect()
    for r in rows:
        s = r["x"]
        n = len(s)
        h = -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0
        assert r["h"] == pytest.approx(h, abs=1e-9)
        assert r["w"] == len(s.split())
        assert r["a"] == sum(c.isalnum() for c in s)
        assert r["s"] == sum(c.isspace() for c in s)
        assert r["q"] == sum(s.count(c) for c in "\"'`")
        assert r["aa"] == s.count("aa")


def test_paths_against_pathlib(spark):
    from pathlib import PurePosixPath, PureWindowsPath

    paths = ["", "cmd.exe", "C:\\Windows\\cmd.exe", "C:/a/b.exe", "C:cmd.exe", "\\\\srv\\share\\x.exe",
             "\\\\srv\\share", "\\a\\b", "a\\b\\", "C:\\", "/usr/bin/x", "/usr/bin/", "a/b"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    p = F.col("p")
    for r in frame.select(p, basename(p).alias("w"), path_depth(p).alias("wd"), basename(p, "posix").alias("x"),
                          path_depth(p, "posix").alias("xd")).collect():
        windows, posix = PureWindowsPath(r["p"]), PurePosixPath(r["p"])
        assert (r["w"], r["wd"]) == (windows.name, len(windows.parts)), r["p"]
        assert (r["x"], r["xd"]) == (posix.name, len(posix.parts)), r["p"]


def test_edge_events_are_total(make_events):
    rows = [{}, dict(CommandLine=""), dict(CommandLine=" \u00a0 "), dict(CommandLine="w " * 20000),
            dict(EventTime="2024-01-01"), dict(EventTime="2024-01-01 23:10:00"), dict(Image="C:cmd.exe")]
    table = feature_table(make_events(rows), ALL).orderBy("event_key").collect()
    assert len(table) == len(rows)
    assert all(x is not None for r in table for x in r)
    assert [r["event_hour"] for r in table][4:6] == [12, 23]
    assert table[5]["is_off_hours"] == 1 and table[3]["cmdline_word_count"] == 20000
    empty = {n: table[0][n] for n in FEATURES}
    assert {n for n, x in empty.items() if x != 0} == {"event_hour"}


def test_patterns_all_hit_somewhere(events):
    flags = [n for n in GROUPS["obfuscation"][0] if n.startswith("obfuscation_") and not n.endswith("score")
             and not n.endswith("intensity")]
    row = feature_table(events, flags).agg(*[F.max(n).alias(n) for n in flags]).first()
    assert set(row.asDict().values()) == {1}


def test_vector_summary(make_events):
    rows = make_events([dict(embedding=[1.0, 2.0, 3.0]), dict(embedding=[]), {}], embedding="array<float>")
    got = feature_group(rows, "embedding").orderBy("event_key").collect()
    assert list(got[0])[1:] == pytest.approx([2.0, math.sqrt(2 / 3), 1.0, 3.0])
    assert list(got[1])[1:] == list(got[2])[1:] == [0.0] * 4


def test_reason_features_null_without_verdict(events):
    row = reason_features(events).filter("event_key = 0").first()
    assert set(list(row)[1:]) == {None}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_is_narrow_and_pruned(spark, tmp_path):
    from groundtrace.sources.events import read_events

    (tmp_path / "e.json").write_text('{"CommandLine": "cmd"}\n')
    from groundtrace.operators.prepare import prepare_events

    raw = read_events(spark, str(tmp_path)).withColumn("event_key", F.monotonically_increasing_id())
    plan = plan_of(feature_table(prepare_events(raw)))
    assert "Exchange" not in plan and "Python" not in plan
    few = feature_table(prepare_events(raw.drop("event_key"), ()), ["has_piping"], keep=())
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan_of(few)).group(1)
    assert read == "CommandLine:string"


def test_text_columns_of_whole_documents(spark, monkeypatch):
    """The query deals rows out, whatever the tasks of the scan, and its entropy is that of the sorted characters."""
    from groundtrace.catalog.queries import QUERIES

    monkeypatch.setattr("groundtrace.session.FEWEST", 10)
    table = QUERIES["document_obfuscation"](spark, "/root/testdata/sf0.001")
    assert table.rdd.getNumPartitions() > 4
    texts = ["", "a", "aab", "é€éa a", "𝒳𝒳x\x00\x00", "\t\r\n \x0b", "'\"\\\\[]" * 50, "ab c" * 3000 + "日本本", None]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for row in frame.select("x", t.entropy_of_long(t.nz(F.col("x"))).alias("e")).collect():
        n = Counter(row.x or "")
        total = sum(n.values())
        assert row.e == pytest.approx(-sum(k / total * math.log2(k / total) for k in n.values()), abs=1e-9)


def test_entropy_in_two_steps(spark, monkeypatch):
    from groundtrace.operators import obfuscation as ob

    texts = ["", None, "a", "abab", "été é " * 40, "x" * 1000 + "y", "日本語" * 77 + "\n\t"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    whole = {r.id: r.entropy for r in ob.text_entropy(rows, "text", ("id",)).collect()}
    for size in (7, 1 << 18):
        monkeypatch.setattr(ob, "SLICE", size)
        parts = {r.id: r.entropy for r in ob.long_text_entropy(rows, "text", ("id",)).collect()}
        assert parts.keys() == whole.keys() and all(abs(parts[k] - whole[k]) < 1e-9 for k in whole)
    assert ob.long_text_entropy(rows.limit(0), "text", ("id",)).count() == 0


def test_entropy_of_a_very_long_text(spark):
    from groundtrace.operators.obfuscation import long_text_entropy

    long = spark.range(1).select("id", F.repeat(F.lit("abcdefgh"), 1_500_000).alias("text"))
    assert abs(long_text_entropy(long, "text", ("id",)).first()["entropy"] - 3.0) < 1e-12


def test_features_by_command(spark, events):
    from groundtrace.operators.feature_table import COMMAND_FEATURES, FEATURES, feature_table, feature_table_by_command

    assert len(COMMAND_FEATURES) == 58 and set(COMMAND_FEATURES) < set(FEATURES)
    commands = events.select("CommandLine").distinct().withColumn("event_key", F.lit(1))
    alone = feature_table(commands, COMMAND_FEATURES, ("CommandLine",))  # nothing but the command is there
    both = feature_table(events, COMMAND_FEATURES, ("CommandLine",)).distinct()
    assert both.exceptAll(alone).count() == 0
    rows = events.unionByName(events.limit(20).withColumn("CommandLine", F.lit(None).cast("string")))
    one, two = feature_table(rows), feature_table_by_command(rows)
    assert one.columns == two.columns and one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    few = ["is_system_user", "process_id"]
    assert feature_table_by_command(rows, few).exceptAll(feature_table(rows, few)).count() == 0


def test_commands_that_repeat_are_looked_at_once(spark, events, monkeypatch):
    from groundtrace.operators import feature_table as ft

    keep = ("event_key", "label")
    want = ft.feature_table(events, keep=keep)
    assert "Join" not in ft.features_of_batch(events, keep=keep)._jdf.queryExecution().toString()  # few events
    monkeypatch.setattr(ft, "MANY", 10)
    found = ft.features_of_batch(events, keep=keep)
    assert "Join" in found._jdf.queryExecution().toString()
    assert found.columns == want.columns and found.dtypes == want.dtypes
    assert found.exceptAll(want).isEmpty() and want.count() == found.count()
    monkeypatch.setattr(ft, "DIFFERENT", 5)
    assert "Join" not in ft.features_of_batch(events, keep=keep)._jdf.queryExecution().toString()  # too many commands


def test_features_by_kind(spark, events, make_events, monkeypatch):
    """Rules that read several fields are looked at once per kind of event; nulls and empty texts are of one kind."""
    from groundtrace.operators import feature_table as ft

    assert len(ft.KIND_FEATURES) == 87
    odd = [dict(Image="a", User=None), dict(Image=None, SourceImage="a"), dict(User="a"), dict(CommandLine="a", Image=""), {},
           dict(Image="C:\\cmd.exe", SourcePort=9), dict(Image="C:\\cmd.exe", DestinationIp="::1"), dict(Image="C:\\cmd.exe", SourcePort=0)]
    for rows in (make_events(odd), events.limit(300)):
        one, two = ft.feature_table(rows), ft.feature_table_by_kind(rows)
        assert one.dtypes == two.dtypes and sorted(one.collect()) == sorted(two.collect())
    monkeypatch.setattr(ft, "MANY", 10)
    monkeypatch.setattr(ft, "TIMES", 0.01)
    asked = []
    monkeypatch.setattr(ft, "stored", lambda df: asked.append(df.columns) or df)
    ft.features_of_batch(events)
    assert set(asked[0]) == {"_digest", *ft.KIND_FEATURES}
