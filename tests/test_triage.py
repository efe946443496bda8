"""Attack types, failure patterns, heuristics, agreement and outcomes."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from groundtrace import vocabulary as v
from groundtrace.catalog.binding import process_events
from groundtrace.operators import contributions as co
from groundtrace.operators import labels as lb
from groundtrace.operators import triage as tr
from groundtrace.plans import comparison as cp


def top(spark, pairs):
    data = [([(n, 1.0, c) for n, c in pairs],)]
    return spark.createDataFrame(data, f"top {co.ITEM}")


@pytest.mark.parametrize("pairs, want", [
    ([("process_discovery", 0.5), ("apt_exfiltration", 1.5), ("system_file_modification", 0.2)], "exfiltration"),
    ([("totally_unknown_feature", 0.9), ("another_feature", 0.3)], "attack type uncertain"),
    ([("process_discovery", 0.5), ("compression_operation", -0.5)], "discovery"),
    ([("my_credential_flag", 0.2)], "credential_access"),
    ([("compression_operation", 0.3), ("process_discovery", 0.2), ("network_discovery", 0.2)], "discovery"),
    ([], "attack type uncertain"),
])
def test_attack_type(spark, pairs, want):
    assert top(spark, pairs).select(co.infer_attack_type(F.col("top"))).first()[0] == want


@pytest.mark.parametrize("event, pattern, word", [
    (dict(CommandLine="powershell -enc aGVsbG8=", User="svc_admin"), v.SUBTLE_OBFUSCATION, "obfuscation"),
    (dict(CommandLine="Get-ADUser -Filter *", User="DOMAIN\\AdminUser"), v.CONTEXT_LEGITIMATE, "dministrative"),
    (dict(CommandLine="pwsh -File deploy.ps1", Image="C:\\\\Tools\\\\pwsh.exe"), v.NOVEL_TECHNIQUE, "keyword"),
    (dict(CommandLine="schtasks /query", User="NT AUTHORITY\\SYSTEM"), v.CONTEXT_LEGITIMATE, "privileged"),
    (dict(CommandLine="schtasks /query", AccountName="HOST$"), v.CONTEXT_LEGITIMATE, "privileged"),
    (dict(CommandLine="notepad.exe a", Image="C:\\a\\notepad.exe"), v.UNMAPPED, "No heuristic"),
    (dict(CommandLine="pwsh x", Image="cmd.exe"), v.UNMAPPED, "No heuristic"),
    ({}, v.UNMAPPED, "No heuristic"),
])
def test_failure_pattern(make_events, event, pattern, word):
    row = tr.classify_failures(make_events([event])).first()
    assert row["failure_pattern"] == pattern and word in row["evidence"]


@pytest.mark.parametrize("event, label, reasons", [
    (dict(CommandLine="powershell -enc AAAA", Image="C:\\x\\PowerShell.exe"), "malicious",
     "Uses native system binary powershell.exe. Contains encoded commands"),
    (dict(CommandLine="cmd /c dir", Image="C:\\cmd.exe", IntegrityLevel="Medium"), "benign",
     "Uses common administrative commands. Executed with appropriate integrity level. integrity is Medium"),
    (dict(CommandLine="x"), "benign", "No suspicious indicators detected"),
])
def test_heuristic_verdict(make_events, event, label, reasons):
    row = tr.heuristic_verdict(make_events([event])).first()
    assert (row["heuristic_verdict"], row["heuristic_reasons"]) == (label, reasons)


def test_reasons_for_another_verdict(make_events):
    row = tr.heuristic_verdict(make_events([dict(CommandLine="x")]), F.lit("malicious")).first()
    assert row["heuristic_reasons"] == v.REASON_MALICIOUS_FALLBACK


def test_rule_hits_from_a_table(spark, make_events):
    pairs = [("r1", "abc"), ("r2", "zzz"), ("r3", ""), ("r4", "b"), ("r5", "xabcx"), ("r1", "abc"), ("r6", None)]
    rules = spark.createDataFrame(pairs, "rule string, indicator string")
    commands = [dict(CommandLine="xABCx"), {}, dict(CommandLine="xABCx abc"), dict(CommandLine="zz")]
    hits = tr.rule_hits(make_events(commands), rules).collect()
    texts = ["xabcx", "", "xabcx abc", "zz"]
    known = {p for p in pairs if p[1] is not None}
    assert sorted(map(tuple, hits)) == sorted((i, r, w) for i, x in enumerate(texts) for r, w in known if w in x)


def test_twenty_thousand_rules(spark, events):
    many = spark.range(20_000).select(F.concat(F.lit("r"), F.col("id")).alias("rule"),
                                      F.concat(F.lit("no such text "), F.col("id")).alias("indicator"))
    own = spark.createDataFrame(tr.technique_rule_list(), "rule string, indicator string")
    joined = tr.rule_hits(events, many.unionByName(own))
    listed = tr.rule_hits(events)
    assert joined.count() == listed.distinct().count() and listed.distinct().exceptAll(joined).isEmpty()


def test_agreement_halves_partition_the_input(events):
    agree, other = lb.split_by_agreement(events)
    assert agree.count() + other.count() == events.count()
    assert other.filter("reviewer IS NULL").count() == events.filter("reviewer IS NULL").count() > 0


def test_labels_strict(spark, events):
    assert lb.get_labels(events.withColumn("_label", F.col("label"))).count() == events.count()
    with pytest.raises(Exception, match="reviewer label"):
        lb.get_labels(events, "reviewer").select("label").collect()


def test_outcomes(spark):
    rows = [("benign", "benign", "malicious"), ("benign", "malicious", "benign"),
            ("benign", "benign", "benign"), ("benign", "malicious", "malicious")]
    got = spark.createDataFrame(rows, "t string, r string, m string").select(
        lb.outcome(F.col("t"), F.col("r"), F.col("m")))
    assert [x[0] for x in got.collect()] == ["reviewer_only", "model_only", "both", "neither"]


def test_comparison_and_failures_add_up(events):
    scored = tr.heuristic_verdict(events).withColumnRenamed("heuristic_verdict", "prediction")
    result = cp.compare(scored)
    counts = {r["outcome"]: r["n"] for r in result.outcomes.collect()}
    assert sum(counts.values()) == events.count()
    analysis = cp.analyze_failures(scored)
    summary = analysis.summary.first()
    assert summary["less_than"] == analysis.less_than.count() == analysis.patterns.count() == counts["reviewer_only"]
    assert summary["better_than"] == analysis.better_than.count() == counts["model_only"]
    assert sum(r["n"] for r in result.by_technique.collect()) == result.disagreements.count()
    plan = result.cases._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # tasks keep their own first rows before the shuffle


def test_computed_filters_stay_above_their_columns(spark):
    scored = tr.heuristic_verdict(process_events(spark, SF.replace("0.001", "0.01"))).withColumnRenamed("heuristic_verdict", "prediction")
    plan = lb.misclassified(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"- Filter \(", plan)) == 1 and "_task" in plan


def test_rules_of_one_beginning_meet_few_commands(spark):
    """20,000 rules and 3,000 commands that all begin alike: by first characters that would be 60 million pairs."""
    from groundtrace.operators import rule_join

    rules = spark.range(20_000).select(F.concat(F.lit("net use share"), F.md5(F.col("id").cast("string"))).alias("indicator"))
    texts = spark.range(3_000).select(F.concat(F.lit("net use share"), F.md5((F.col("id") * 7).cast("string")), F.lit(" /y")).alias("text"))
    commands = texts.select(F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).alias("digest"), "text")
    pairs = rule_join.candidates(commands, rules)
    assert pairs.count() <= 20_000  # a gram of five hexadecimal digits at least is particular to a rule or missing
    events = texts.select(F.monotonically_increasing_id().alias("event_key"), F.col("text").alias("CommandLine"))
    hits = tr.rule_hits(events, rules.withColumn("rule", F.lit("r")))
    assert hits.count() == sum(1 for i in range(3_000) if i * 7 < 20_000)
    assert hits.select("event_key").distinct().count() == hits.count()


def test_frequent_grams_are_salted(spark):
    from groundtrace.operators import rule_join

    commands = spark.range(500).select(F.struct(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b")).alias("digest"),
                                       F.concat(F.lit("aaaa"), F.col("id").cast("string")).alias("text"))
    rules = spark.createDataFrame([("aaaa",), ("aaaaa",), ("aaa",), ("",)], "indicator string")
    few = rule_join.candidates(commands, rules, hot=7).collect()
    assert sorted(map(str, few)) == sorted(map(str, rule_join.candidates(commands, rules).collect()))
    assert len(few) == 2_000  # the grams of the second are those of the first; the comparison rejects it


def test_rules_in_long_texts(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(200_000)) + " the Needle é at the end"
    events = spark.createDataFrame([(1, text), (2, text[:65_536 + 2]), (3, None)], "event_key long, CommandLine string")
    rules = spark.createDataFrame([("a", "needle é"), ("b", text[65_530:65_545]), ("c", text[250:262]), ("d", "é")], "rule string, indicator string")
    known = [("a", "needle é"), ("b", text[65_530:65_545]), ("c", text[250:262]), ("d", "é")]
    want = sorted((k, r) for k, t in ((1, text.lower()), (2, text[:65_538])) for r, w in known if w in t)
    assert sorted((h.event_key, h.rule) for h in tr.rule_hits(events, rules).collect()) == want


def test_failure_analysis_reads_its_input_once(spark, events, tmp_path):
    from groundtrace.plans import comparison as cp

    path = str(tmp_path / "scored")
    tr.heuristic_verdict(events).withColumnRenamed("heuristic_verdict", "prediction").write.parquet(path)
    scored = spark.read.parquet(path)
    analysis = cp.analyze_failures(scored)
    for df in (analysis.less_than, analysis.better_than, analysis.patterns, analysis.summary):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert path not in plan and "outcome" in plan  # what was written once, by outcome
    summary = analysis.summary.first()
    assert (analysis.less_than.count(), analysis.better_than.count()) == (summary["less_than"], summary["better_than"])
    want = lb.with_outcome(scored).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in want}["reviewer_only"] == summary["less_than"]


def test_small_rule_tables_move_no_texts(spark, monkeypatch):
    from groundtrace.operators import rule_join, rule_scan

    monkeypatch.setattr(rule_scan, "BLOCK", 50)
    texts = ["", None, "a", "aaaaaaaaaaaaaaaa", "net use", "x" * 49 + "needle in hay" + "y" * 90 + "needle in hay", "Éa日本語日本語x", "\x00a\x00", "needle in ha", "y needle in"]
    known = [("e", ""), ("e2", ""), ("n", None), ("1", "a"), ("2", "needle in hay"), ("2", "needle in hay"), ("3", "needle in hay"),
             ("4", "日本語x"), ("5", "aaaaaaaaa"), ("6", "hayy"), ("7", "\x00"), ("8", "nowhere to be found"), (None, "éa"), ("9", "needle in")]
    events = spark.createDataFrame(list(enumerate(texts)), "event_key long, CommandLine string").repartition(3)
    rules = spark.createDataFrame(known, "rule string, indicator string")
    want = sorted(str((k, r, w)) for k, t in enumerate(texts) for r, w in set(known) if w is not None and w in (t or "").lower())
    found = tr.rule_hits(events, rules)
    assert sorted(str(tuple(h)) for h in found.collect()) == want
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "Join" not in found._jdf.queryExecution().toString()
    staged = events.selectExpr("event_key", "lower(coalesce(CommandLine, '')) AS _lc")
    joined = rule_join.joined_hits(staged, rules.filter("rule is not null"), ("event_key",), small=-1)
    assert sorted(str(tuple(h)) for h in joined.collect()) == [x for x in want if ", None, " not in x]
    assert tr.rule_hits(events, rules.limit(0)).count() == 0
