"""Models, attributions, explanations, streaming."""

import itertools
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from groundtrace.catalog.queries import event_stream
from groundtrace.operators import contributions as co
from groundtrace.operators import forest as fo
from groundtrace.operators.feature_table import feature_table
from groundtrace.operators import metrics as mt
from groundtrace.operators import tree_attributions as ta
from groundtrace.plans import scoring as sc
from groundtrace.plans import training as tn
from groundtrace.session import shared_folder
from groundtrace.streaming import score as st

NAMES = ["apt_defense_evasion", "apt_exfiltration", "apt_lotl_score", "cmdline_entropy", "cmdline_length", "compression_operation",
         "is_system_user", "native_binary_abuse_score", "network_discovery", "num_dashes", "obfuscation_score", "process_discovery",
         "system_account_admin_tool"]


@pytest.fixture(scope="module")
def table(spark, events):
    return sc.labelled_features(events, NAMES).persist()


@pytest.fixture(scope="module")
def model(table):
    return fo.fit_forest(table, NAMES, fo.ForestSettings(trees=3, depth=4))


def test_forest_quality_and_persistence(spark, table, model, tmp_path):
    scored = fo.score(model, table, ["event_key", "label"])
    row = mt.binary_metrics(scored).first()
    assert row["precision"] > 0.9 and row["recall"] > 0.75
    assert row["tp"] + row["fp"] + row["tn"] + row["fn"] == table.count()
    assert scored.filter(F.abs(F.greatest("p_malicious", 1 - F.col("p_malicious")) - F.col("confidence")) > 1e-12).isEmpty()
    fo.save_forest(model, spark, str(tmp_path / "m"))
    loaded = fo.load_forest(spark, str(tmp_path / "m"))
    assert loaded.names == model.names and loaded.statistics == model.statistics
    again = fo.score(loaded, table, ["event_key", "label"])
    assert scored.select("event_key", "p_malicious").exceptAll(again.select("event_key", "p_malicious")).isEmpty()


def test_unknown_label_is_an_error(spark, table):
    with pytest.raises(Exception, match="unknown label"):
        fo.fit_forest(table.withColumn("label", F.lit("odd")), NAMES)


def test_top_k(spark, table, model):
    ranked = fo.top_features(model, 3)
    values = [model.importances[n] for n in ranked]
    assert values == sorted(model.importances.values(), reverse=True)[:3]
    assert len(fo.fit_top_k(table, NAMES, 2, fo.ForestSettings(2, 3)).names) == 2
    assert fo.importance_table(spark, model).count() == len(NAMES)


def brute_force(model, nodes, x):
    """Path-dependent Shapley values by enumerating all feature subsets."""
    trees = {}
    for n in nodes:
        trees.setdefault(n["treeID"], {})[n["id"]] = n

    def expect(tree, node, known):
        if node["leftChild"] < 0:
            return node["impurityStats"][1] / sum(node["impurityStats"])
        left, right = tree[node["leftChild"]], tree[node["rightChild"]]
        if node["feature"] in known:
            go = left if x[node["feature"]] <= node["threshold"][0] else right
            return expect(tree, go, known)
        wl, wr = sum(left["impurityStats"]), sum(right["impurityStats"])
        return (wl * expect(tree, left, known) + wr * expect(tree, right, known)) / (wl + wr)

    used = sorted({n["feature"] for n in nodes if n["leftChild"] >= 0})
    value = {s: sum(expect(t, t[0], s) for t in trees.values()) / len(trees)
             for r in range(len(used) + 1) for s in map(frozenset, itertools.combinations(used, r))}
    phi, m = np.zeros(len(x)), len(used)
    for f in used:
        for s in value:
            if f not in s:
                w = math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m)
                phi[f] += w * (value[s | {f}] - value[s])
    return value[frozenset()], phi


def test_attributions(spark, table):
    names = NAMES[:6]
    small = fo.fit_forest(table, names, fo.ForestSettings(trees=2, depth=3))
    scored = fo.score(small, table, ["event_key"])
    found = ta.tree_attributions(scored, small, ("event_key", "p_malicious", *names)).persist()
    total = F.aggregate("attributions", F.col("base_value"), lambda acc, x: acc + x)
    assert found.filter(F.abs(total - F.col("p_malicious")) > 1e-9).isEmpty()
    nodes = ta.forest_nodes(spark, small)
    for row in found.orderBy("event_key").limit(8).collect():
        base, phi = brute_force(small, nodes, [row[n] for n in names])
        assert row["base_value"] == pytest.approx(base, abs=1e-9)
        assert row["attributions"] == pytest.approx(list(phi), abs=1e-9)
    wide = found.select("event_key", F.posexplode("attributions").alias("i", "c")).select(
        "event_key", F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("feature"), "c")
    joined = wide.join(ta.tree_attributions_by_join(scored, small), ["event_key", "feature"], "left")
    assert joined.filter(F.abs(F.col("c") - F.coalesce("contribution", F.lit(0.0))) > 1e-9).isEmpty()


def test_deep_forest(spark):
    """Paths of up to fifteen different features: sums are exact, and shares agree with the joined form's tables."""
    rng = np.random.default_rng(4)
    names = [f"x{i}" for i in range(24)]
    x = rng.normal(size=(600, 24))
    label = np.where((x[:, :8].prod(axis=1) + x[:, 8:].sum(axis=1) * 0.1 + rng.normal(size=600) * 0.3) > 0, "malicious", "benign")
    rows = [(i, str(label[i]), *map(float, x[i])) for i in range(600)]
    table = spark.createDataFrame(rows, "event_key int, label string, " + ", ".join(f"{n} double" for n in names))
    deep = fo.fit_forest(table, names, fo.ForestSettings(trees=2, depth=15))
    leaves, base = ta.leaf_patterns(spark, deep)
    longest = max(leaves, key=lambda leaf: len(leaf.features))
    assert len(longest.features) >= 10
    scored = fo.score(deep, table, ["event_key"])
    found = ta.tree_attributions(scored, deep, ("event_key", "p_malicious"))
    total = F.aggregate("attributions", F.col("base_value"), lambda acc, x: acc + x)
    assert found.filter(F.abs(total - F.col("p_malicious")) > 1e-9).isEmpty()
    d = len(longest.ratios)
    inside = rng.integers(0, 2, size=(4, d))
    for bits, shares in zip(inside, ta._shares(longest.ratios, longest.probability, inside)):
        assert shares == pytest.approx(subset_shares(longest.ratios, longest.probability, bits), abs=1e-12)


def subset_shares(ratios, probability, bits):
    """Shapley shares by averaging over all subsets."""
    d = len(ratios)
    value = np.ones(1)
    for r, b in zip(ratios, bits):  # value of every subset: in-bits inside, ratios outside
        value = np.concatenate([value * r, value * b])
    sizes = np.array([bin(s).count("1") for s in range(1 << d)])
    out = []
    for i in range(d):
        without = np.flatnonzero((np.arange(1 << d) >> i) & 1 == 0)
        weight = np.array([1 / (d * math.comb(d - 1, k)) for k in range(d)])[sizes[without]]
        out.append((weight * (value[without | (1 << i)] - value[without])).sum() * probability)
    return out


def test_contributions_and_explanations(events, model):
    rows = sc.explain_events(events, model, keep=("event_key",)).orderBy("event_key").limit(20).collect()
    for r in rows:
        sizes = [abs(x["contribution"]) for x in r["top_features"]]
        assert len(sizes) == 5 and sizes == sorted(sizes, reverse=True)
        assert f"classified as **{r['prediction']}** with " in r["explanation"]
        assert ("**Attack Type**" in r["explanation"]) == (r["prediction"] == "malicious")
        assert r["explanation"].count("(value: ") == 5
    scored = fo.score(model, feature_table(events, model.names), ["event_key"])
    every = {r["event_key"]: r["attributions"]
             for r in ta.tree_attributions(scored, model, ("event_key",)).limit(50).collect()}
    for r in ta.top_attributions(scored, model, ("event_key",)).limit(50).collect():
        ranked = sorted(zip(model.names, every[r["event_key"]]), key=lambda x: -abs(x[1]))[:5]
        assert [(x["name"], x["contribution"]) for x in r["top_features"]] == ranked
    alerts = sc.explain_events(events, model, exact=True, alerts_only=True)
    assert {r["prediction"] for r in alerts.select("prediction").distinct().collect()} == {"malicious"}


def test_ties_and_short_lists(spark):
    items = [("a", 1.0, 0.5), ("b", 1.0, -0.5), ("c", 1.0, 0.1)]
    columns = [(n, F.lit(x), F.lit(c)) for n, x, c in items]
    for ties, want in (("last", ["b", "a", "c"]), ("first", ["a", "b", "c"])):
        got = spark.range(1).select(co.strongest(columns, 5, ties).alias("t")).first()["t"]
        assert [x["name"] for x in got] == want
    text = spark.range(1).select(co.drivers_text(co.item_array(columns))).first()[0]
    assert text == "Key indicators: a, c; Mitigating factors: b"


@pytest.mark.parametrize("name, value, contribution, benign, want", [
    ("obfuscation_base64_encoding", 1.0, 0.25, False,
     "**Base64 Encoding obfuscation detected** (value: 1.00, SHAP: 0.250): Command contains base64 encoding patterns used to hide malicious intent."),
    ("cmdline_entropy", 5.0, 0.1, False,
     "**High command-line entropy** (value: 5.00, SHAP: 0.100): High randomness suggests obfuscation or encoding in the command."),
    ("text_embedding_dim_3", 0.5, -0.0001, False,
     "**Text embedding dimension 3** (value: 0.500, SHAP: 0.000): Semantic feature from sentence transformer capturing command/path/context meaning."),
    ("system_binary_from_explorer", 1.0, 0.2, False,
     "**System binary from Explorer** (value: 1.00, SHAP: 0.200): cmd.exe launched from Explorer - unusual as system binaries typically run from system processes."),
    ("apt_collection", 0.0, 0.2, True,
     "**Apt Collection** (value: 0, SHAP: 0.200): This feature indicates benign activity."),
    ("text_embedding_max", 0.1, 0.2, False,
     "**Text Embedding Max** (value: 0.100, SHAP: 0.200): This feature suggests malicious activity."),
])
def test_sentences(spark, name, value, contribution, benign, want):
    frame = spark.createDataFrame([(name, value, contribution, benign)], "n string, v double, c double, b boolean")
    got = frame.select(co.explain_feature(F.col("n"), F.col("v"), F.col("c"), F.col("b"), F.lit("cmd.exe"), F.lit("u")))
    assert got.first()[0] == want


def test_cross_validation(events, spark, tmp_path):
    result = tn.cross_validate(events, folds=2, augment_share=0.5, names=NAMES,
                               settings=fo.ForestSettings(2, 3))
    assert result.predictions.count() == events.count()
    assert result.predictions.select("event_key").distinct().count() == events.count()
    folds = result.per_fold.collect()
    assert len(folds) == 2 and all(r["throughput_events_per_sec"] > 0 for r in folds)
    average = result.average.first()
    assert average["f1"] == pytest.approx(np.mean([r["f1"] for r in folds]))
    assert average["f1_std"] == pytest.approx(np.std([r["f1"] for r in folds]))
    tn.write_validation(result, str(tmp_path / "cv"), n_splits=2, random_seed=42)
    assert spark.read.json(str(tmp_path / "cv" / "folds")).count() == 2


def test_disagreement_scores_compute_used_features_only(events, monkeypatch):
    base, asked, whole = ("cmdline_length", "num_quotes", "cmdline_entropy"), [], tn.disagreement_features
    model = tn.fit_disagreement_model(events, base=base, settings=fo.ForestSettings(1, 1, bootstrap=False))
    every = fo.score(model, whole(events, ("event_key",), base), ["event_key"])
    monkeypatch.setattr(tn, "disagreement_features", lambda df, keep, names, **more: asked.extend(names) or whole(df, keep, names, **more))
    found = tn.score_disagreement(events, model, base=base)
    assert set(asked) <= set(model.used) and len(model.used) <= 1
    assert {tuple(r) for r in found.select("event_key", "p_disagreement").collect()} == {
        tuple(r) for r in every.select("event_key", "p_malicious").collect()}


def test_holdout_and_disagreement_model(events):
    scored, metrics, cost = tn.evaluate_holdout(events, names=NAMES, settings=fo.ForestSettings(2, 3))
    assert scored.count() == cost.first()["alerts"] == sum(metrics.first()[c] for c in ("tp", "fp", "tn", "fn"))
    model = tn.fit_disagreement_model(events, base=("cmdline_length",), settings=fo.ForestSettings(3, 3))
    assert "label_mismatch" not in model.names
    leaky = tn.fit_disagreement_model(events, with_mismatch=True, base=("cmdline_length",),
                                      settings=fo.ForestSettings(3, 3))
    assert "label_mismatch" in leaky.names
    scores = tn.score_disagreement(events, model, base=("cmdline_length",))
    assert scores.filter("p_disagreement < 0 OR p_disagreement > 1").isEmpty() and scores.count() == events.count()


def test_network_and_vote(table, model):
    network = fo.fit_network(table, NAMES, (8,), 10)
    scored = fo.score_network(network, table, ["event_key", "label"])
    assert scored.count() == table.count()
    vote = fo.soft_vote(model, network, table, ["event_key"])
    singles = fo.score(model, table, ["event_key"]).select("event_key", F.col("p_malicious").alias("a")).join(
        scored.select("event_key", F.col("p_malicious").alias("b")), "event_key").join(vote, "event_key")
    assert singles.filter(F.abs((F.col("a") + F.col("b")) / 2 - F.col("p_malicious")) > 1e-9).isEmpty()


def test_stream_equals_batch(spark, model):
    from groundtrace.catalog.binding import raw_process_events

    folder = f"{shared_folder(spark)}/stream-test"
    stream = st.score_stream(event_stream(spark, SF), model)
    st.write_scores(stream, folder + "/out", folder + "/checkpoint").awaitTermination()
    got = spark.read.parquet(folder + "/out").select("event_key", "prediction", "confidence", "drivers")
    want = st.score_stream(raw_process_events(spark, SF), model).select(*got.columns)
    assert got.count() == want.count() == 1000
    assert got.exceptAll(want).isEmpty()


def test_reports(spark):
    rows = [("malicious", "malicious")] * 3 + [("benign", "malicious")] + [("benign", "benign")] * 2
    report = {r["row"]: r for r in mt.class_report(spark.createDataFrame(rows, "label string, prediction string")).collect()}
    assert report["malicious"]["precision"] == 0.75 and report["benign"]["recall"] == pytest.approx(2 / 3)
    assert report["accuracy"]["f1"] == pytest.approx(5 / 6) and report["macro avg"]["support"] == 6
    empty = mt.binary_metrics(spark.createDataFrame([], "label string, prediction string")).first()
    assert list(empty) == [0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0]


def test_holdout_rows_keep_event_fields(events):
    from groundtrace.operators.labels import misclassified

    scored, metrics, _ = tn.evaluate_holdout(events, settings=fo.ForestSettings(trees=5, depth=3), names=NAMES,
                                             keep=("CommandLine", "User"))
    assert {"CommandLine", "User", "prediction"} <= set(scored.columns)
    row = metrics.first()
    assert misclassified(scored).count() == row["fp"] + row["fn"]


def test_strongest_of_a_table_as_of_a_row(spark):
    from groundtrace.operators import contributions as co

    rows = [[float((i * 37 + j * 11) % 7 - 3) for j in range(20)] for i in range(40)] + [[0.0] * 20, [float("nan")] * 3 + [1.0] * 17, [None] * 18 + [2.0, -2.0]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_key long, " + ", ".join(f"c{j} double" for j in range(20)))
    items = [(f"c{j}", F.col(f"c{j}"), F.col(f"c{j}") * 2) for j in range(20)]
    want = df.select("event_key", co.strongest(items).alias("top_features")).orderBy("event_key").collect()
    assert str(co.with_strongest(df, ["event_key"], items).orderBy("event_key").collect()) == str(want)
    few = co.with_strongest(df, ["event_key"], items[:2]).orderBy("event_key").collect()
    assert str(few) == str(df.select("event_key", co.strongest(items[:2]).alias("top_features")).orderBy("event_key").collect())


def test_models_are_compared_without_a_join(spark):
    from groundtrace.catalog.queries import QUERIES

    found = QUERIES["saved_models"](spark, "/root/testdata/sf0.001")
    assert "Join" not in found._jdf.queryExecution().toString()
    assert all(r["events"] == r["equal"] == 1000 for r in found.collect())


def test_rows_that_no_split_tells_apart_are_attributed_once():
    rng = np.random.default_rng(3)
    leaves = [ta.Leaf(0, n, np.array(sorted(rng.choice(4, 3, replace=False))), np.array([-np.inf, *rng.integers(0, 5, 2)]),
                      np.array([*rng.integers(2, 7, 2), np.inf]), rng.uniform(0.1, 0.9, 3), rng.uniform()) for n in range(60)]
    values = rng.integers(0, 8, (500, 5)).astype(float)
    values[:3, :2] = np.nan, np.inf
    values[:, 4] = np.arange(500)  # an id that no split looks at
    first, back = ta.alike(values[:, :5], leaves)
    assert np.array_equal(ta.attribute(values, leaves), ta._attribute(values, leaves))
    assert len(ta.alike(np.repeat(values[:20], 9, axis=0), leaves)[0]) <= 20 and back.max() + 1 == len(first)
    assert ta.attribute(values[:0], leaves).shape == (0, 5) and len(ta.alike(values, [])[0]) == 1


def test_scoring_computes_what_the_forest_uses(table, model):
    assert set(model.used) == {n for n, x in model.importances.items() if x > 0} < set(model.names)
    few = fo.score(model, table.select("event_key", *model.used), ["event_key"]).select("event_key", "p_malicious")
    assert sorted(few.collect()) == sorted(fo.score(model, table, ["event_key"]).select("event_key", "p_malicious").collect())


def test_stream_scored_by_batch(spark, model, tmp_path, monkeypatch):
    """A micro-batch takes the form by kind, and gives what the narrow stream gives."""
    from groundtrace.catalog.binding import raw_process_events
    from groundtrace.operators import feature_table as ft

    monkeypatch.setattr(ft, "MANY", 10)
    monkeypatch.setattr(ft, "TIMES", 0.01)
    called = []
    by_kind = ft.feature_table_by_kind
    monkeypatch.setattr(ft, "feature_table_by_kind", lambda *a: called.append(1) or by_kind(*a))
    st.write_scored_batches(event_stream(spark, SF), str(tmp_path), f"{tmp_path}/checkpoint",
                            lambda batch: st.score_stream(batch, model)).awaitTermination()
    found = st.read_batches(spark, str(tmp_path), "scores").select("event_key", "prediction", "confidence", "drivers")
    want = st.score_stream(raw_process_events(spark, SF), model).select(*found.columns)
    assert called and sorted(found.collect()) == sorted(want.collect())


def test_registered_exact_explanations_cover_every_event(spark, tmp_path):
    """One row per event: verdicts of both kinds are explained, each by five features."""
    from groundtrace.catalog.queries import QUERIES

    spark.range(640).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["exact_explanations"](spark, str(tmp_path)).collect()
    assert sorted(r["event_key"] for r in rows) == list(range(640))
    assert {r["prediction"] for r in rows} == {"benign", "malicious"}
    for r in rows:
        assert f"classified as **{r['prediction']}** with " in r["explanation"] and r["explanation"].count("(value: ") == 5


def test_folds_fit_without_statistics(events, monkeypatch):
    """Validation makes no pass for statistics that no one reads, and its forests are those of a fit with them."""
    fit, without = tn._fit, []

    def compared(*given, **how):
        model, plain = fit(*given, **how), fit(*given, **{**how, "statistics": True})
        trees = [m.forest.toDebugString.split("\n", 1)[1] for m in (model, plain)]
        without.append((model.statistics, trees[0] == trees[1], plain.statistics.keys() == set(model.names)))
        return model

    monkeypatch.setattr(tn, "_fit", compared)
    for k in (None, 3):
        assert tn.cross_validate(events, folds=2, names=NAMES, settings=fo.ForestSettings(2, 3), top_k=k).predictions.count() == events.count()
    assert without == [({}, True, True)] * 4
