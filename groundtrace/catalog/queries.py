"""The registered queries: one per operator, each a function (spark, sf_dir) -> DataFrame."""

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundtrace import schema
from groundtrace import vocabulary as v
from groundtrace.catalog.binding import READ, as_process_events, process_events, raw_process_events
from groundtrace.functions import text as t
from groundtrace.operators import contributions as co
from groundtrace.operators import forest as fo
from groundtrace.operators import labels as lb
from groundtrace.operators import metrics as mt
from groundtrace.operators import network as nw
from groundtrace.operators import prepare as pr
from groundtrace.operators import reviewer_rules as rr
from groundtrace.operators import sampling as sm
from groundtrace.operators import tree_attributions as ta
from groundtrace.operators import triage as tr
from groundtrace.operators.base_fields import RuleOptions
from groundtrace.operators.event_rules import embedding_summary as summarise_vectors
from groundtrace.operators.feature_table import FEATURES, feature_group, feature_table, feature_table_by_command, features_of_batch
from groundtrace.operators.obfuscation import long_text_entropy, text_entropy, text_obfuscation
from groundtrace.plans import comparison as cp
from groundtrace.plans import scoring as sc
from groundtrace.plans import training as tn
from groundtrace.session import shared_folder, spread, stored, tasks_of
from groundtrace.sources import sinks
from groundtrace.sources.events import read_events
from groundtrace.sources.sinks import disagreement_extract
from groundtrace.streaming import score as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results compare across engines."""
    return df.select(*[F.round(F.col(n), digits).alias(n) if kind == "double" else F.col(n)
                       for n, kind in df.dtypes])


def judged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the rule-based verdict as ``prediction``."""
    return tr.heuristic_verdict(process_events(spark, sf_dir)).withColumnRenamed(
        "heuristic_verdict", "prediction")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels``: quality as truth, toxic as prediction."""
    names = F.array(F.lit(v.BENIGN), F.lit(v.MALICIOUS))
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("event_key"), F.get(names, F.col("quality")).alias("label"),
        F.get(names, F.col("toxic")).alias("prediction"))


# ---- preparation --------------------------------------------------------------------------------

SHOWN = ("EventID", "EventTime", "Hostname", "Image", "SourceImage", "CommandLine", "ParentImage",
         "ParentCommandLine", "ProcessId", "ParentProcessId", "User", "Domain", "AccountName",
         "IntegrityLevel", "SourcePort", "DestinationPort", "DestinationIp", "Protocol")


@query
def resolve_sanitize(spark, sf_dir):
    return process_events(spark, sf_dir).select("event_key", *SHOWN)


@query
def agreement_split(spark, sf_dir):
    return lb.with_agreement(process_events(spark, sf_dir)).select(
        "event_key", F.col("agreed").cast("int").alias("agreed"))


@query
def reviewer_labels(spark, sf_dir):
    judged = process_events(spark, sf_dir).filter(F.col(schema.REVIEWER).isNotNull())
    return lb.get_labels(judged, "reviewer").select("event_key", "label")


@query
def event_snapshots(spark, sf_dir):
    return pr.event_snapshot(process_events(spark, sf_dir))


@query
def prompt_pairs(spark, sf_dir):
    return pr.distillation_pairs(process_events(spark, sf_dir))


@query
def embedding_texts(spark, sf_dir):
    events = process_events(spark, sf_dir)
    return events.select("event_key", pr.embedding_text(events).alias("text"))


@query
def reviewer_disagreement_extract(spark, sf_dir):
    extract = disagreement_extract(process_events(spark, sf_dir), "label")
    return extract.select(
        F.get_json_object(schema.REVIEWER, "$.predicted_label").alias("reviewer_label"),
        F.get_json_object(schema.REVIEWER, "$.reason").alias("reason"),
        "label", F.col(schema.TECHNIQUE_FIELD).alias("technique"))


@query
def content_keys(spark, sf_dir):
    """Content keys of whole rows, a third of which are there twice: occurrence numbers per row."""
    rows = table(spark, sf_dir, "events")
    keyed = pr.with_event_key(rows.unionAll(rows.filter("event_id % 3 = 0")))
    number = F.substring_index("event_key", "-", -1).cast("bigint")
    return keyed.select(*rows.columns, number.alias("occurrence"))


# ---- features -----------------------------------------------------------------------------------

def _group(name: str, group: str) -> None:
    def run(spark, sf_dir):
        return rounded(feature_group(process_events(spark, sf_dir), group))

    QUERIES[name] = run


for _name, _of in (("native_features", "native"), ("technique_features", "technique"),
                   ("anomaly_features", "anomaly"), ("usage_features", "usage"),
                   ("context_features", "context"), ("obfuscation_features", "obfuscation"),
                   ("event_features", "event"), ("command_features", "command"),
                   ("relation_features", "relation")):
    _group(_name, _of)


@query
def feature_table_totals(spark, sf_dir):
    """All 103 columns, summed per label."""
    features = features_of_batch(process_events(spark, sf_dir), keep=("event_key", "label"))
    return rounded(features.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(n).cast("double")).alias(n) for n in FEATURES]), 3)


@query
def corrected_rule_features(spark, sf_dir):
    """The rules with capitals and doubled back-slashes corrected."""
    options = RuleOptions(fix_case=True, fix_paths=True)
    return feature_table(
        process_events(spark, sf_dir),
        ["apt_lateral_movement", "apt_defense_evasion", "suspicious_path_operation",
         "system_file_modification"], options=options)


@query
def posix_path_features(spark, sf_dir):
    """File names split at "/" only."""
    return feature_table(
        process_events(spark, sf_dir),
        ["is_native_binary", "native_binary_abuse_score", "unusual_binary_combo",
         "image_path_depth"], options=RuleOptions(path_semantics="posix"))


@query
def embedding_summary(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(summarise_vectors(vectors, "embedding", ("vec_id",)), 5)


@query
def reason_features(spark, sf_dir):
    return rr.reason_features(process_events(spark, sf_dir))


@query
def disagreement_features(spark, sf_dir):
    return rounded(rr.disagreement_features(process_events(spark, sf_dir), with_mismatch=True), 4)


@query
def entropy_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return rounded(text_entropy(documents, "text", ("doc_id",)))


@query
def entropy_long_documents(spark, sf_dir):
    """The two-step form for long texts."""
    documents = table(spark, sf_dir, "documents")
    return rounded(long_text_entropy(documents, "text", ("doc_id",)))


@query
def entropy_long_pages(spark, sf_dir):
    return rounded(long_text_entropy(table(spark, sf_dir, "pages"), "html", ("page_id",)))


def _text_columns(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return rounded(text_obfuscation(spread(df.select(*keys, column)), column, keys), 4)


@query
def conversation_text_statistics(spark, sf_dir):
    """All columns of the obfuscation group on conversation turns."""
    return _text_columns(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn")


@query
def url_obfuscation(spark, sf_dir):
    return _text_columns(table(spark, sf_dir, "pages"), "url", "page_id")


@query
def document_obfuscation(spark, sf_dir):
    """The same for whole documents."""
    return _text_columns(table(spark, sf_dir, "documents"), "text", "doc_id")


@query
def page_obfuscation(spark, sf_dir):
    """The same for whole pages."""
    return _text_columns(table(spark, sf_dir, "pages"), "html", "page_id")


@query
def rule_hits_long(spark, sf_dir):
    return tr.rule_hits(process_events(spark, sf_dir))


def benchmark_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from a table: the different sentences of each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("rule"), F.lower("text").alias("text"))
    sentences = items.select("rule", F.explode(F.split("text", r"\.")).alias("part")).select("rule", F.trim("part").alias("indicator"))
    return sentences.filter("indicator <> ''").distinct()


@query
def rule_table_hits(spark, sf_dir):
    """Every whole document and conversation turn against a table of rules."""
    documents = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("event_key"),
                                                         F.col("text").alias("CommandLine"))
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("event_key"), F.col("text").alias("CommandLine"))
    return tr.rule_hits(documents.unionAll(turns), benchmark_rules(spark, sf_dir))


@query
def technique_summary(spark, sf_dir):
    """Technique flags per label: the flagship summary."""
    features = feature_group(process_events(spark, sf_dir), "technique", ("event_key", "label"))
    return features.groupBy("label").agg(
        F.count(F.lit(1)).alias("events"), F.sum("apt_lotl_score").alias("indicator_hits"),
        F.sum("apt_lotl_detected").alias("detected"),
        F.sum("high_confidence_apt").alias("high_confidence"))


# ---- labels, splits, metrics ----------------------------------------------------------------------

@query
def label_distribution(spark, sf_dir):
    return rounded(mt.label_distribution(process_events(spark, sf_dir)))


@query
def class_weights(spark, sf_dir):
    return rounded(mt.class_weights(labelled_documents(spark, sf_dir)))


@query
def stratified_holdout(spark, sf_dir):
    return sm.stratified_holdout(labelled_documents(spark, sf_dir)).select(
        "event_key", "label", "part")


@query
def unstratified_holdout(spark, sf_dir):
    return sm.stratified_holdout(process_events(spark, sf_dir), 0.3, sm.Order(7, stratum=None)
                                 ).select("event_key", "part")


@query
def stratified_kfold(spark, sf_dir):
    return sm.stratified_folds(process_events(spark, sf_dir)).select("event_key", "label", "fold")


@query
def order_folds(spark, sf_dir):
    """Five folds of all orders, stratified by status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    order = sm.Order(42, key="o_orderkey", stratum="o_orderstatus")
    return sm.stratified_folds(orders, 5, order)


@query
def hash_folds(spark, sf_dir):
    return sm.hash_folds(labelled_documents(spark, sf_dir)).select("event_key", "fold")


@query
def confusion_metrics(spark, sf_dir):
    return rounded(mt.binary_metrics(labelled_documents(spark, sf_dir)))


@query
def class_report(spark, sf_dir):
    return rounded(mt.class_report(labelled_documents(spark, sf_dir)))


def _per_fold(spark, sf_dir):
    return mt.binary_metrics(sm.stratified_folds(judged_events(spark, sf_dir)), by=("fold",))


@query
def fold_metrics(spark, sf_dir):
    return rounded(_per_fold(spark, sf_dir))


@query
def fold_metrics_mean_std(spark, sf_dir):
    return rounded(mt.fold_averages(_per_fold(spark, sf_dir)))


@query
def outcome_quadrants(spark, sf_dir):
    return mt.outcome_counts(lb.with_outcome(judged_events(spark, sf_dir)))


@query
def prediction_disagreements(spark, sf_dir):
    found = lb.prediction_disagreements(judged_events(spark, sf_dir))
    return found.select(
        "event_key", "ground_truth", "reviewer_prediction", "model_prediction",
        F.col("reviewer_correct").cast("int").alias("reviewer_correct"),
        F.col("model_correct").cast("int").alias("model_correct"), "attack_technique",
        "reviewer_reason", F.col("event")["CommandLine"].alias("command"))


@query
def disagreement_by_technique(spark, sf_dir):
    return mt.disagreements_by_technique(
        lb.prediction_disagreements(judged_events(spark, sf_dir)))


@query
def top5_cases_per_technique(spark, sf_dir):
    return mt.first_cases(lb.prediction_disagreements(judged_events(spark, sf_dir))).select(
        "attack_technique", "case_no", "event_key", "ground_truth")


@query
def misclassified(spark, sf_dir):
    return lb.misclassified(judged_events(spark, sf_dir))


@query
def model_and_reviewer_metrics(spark, sf_dir):
    return rounded(cp.compare(judged_events(spark, sf_dir)).metrics)


@query
def failure_patterns(spark, sf_dir):
    return tr.classify_failures(process_events(spark, sf_dir)).select(
        "event_key", "failure_pattern", "evidence")


@query
def failure_pattern_counts(spark, sf_dir):
    return tr.pattern_counts(cp.analyze_failures(judged_events(spark, sf_dir)).patterns)


@query
def failure_cases(spark, sf_dir):
    """Both sides' failures from one pass: what each output of the analysis holds."""
    found = cp.analyze_failures(judged_events(spark, sf_dir))
    columns = ["event_key", "ground_truth", "model_prediction", "reviewer_prediction"]
    none = F.lit(None).cast("string")
    return found.patterns.select(*columns, "failure_pattern", "evidence").unionByName(
        found.better_than.select(*columns, none.alias("failure_pattern"), none.alias("evidence")))


@query
def failure_summary(spark, sf_dir):
    return cp.analyze_failures(judged_events(spark, sf_dir)).summary


@query
def heuristic_verdict(spark, sf_dir):
    return tr.heuristic_verdict(process_events(spark, sf_dir)).select(
        "event_key", "heuristic_score", "heuristic_verdict", "heuristic_reasons")


@query
def z_scores(spark, sf_dir):
    """All 103 columns."""
    features = stored(features_of_batch(process_events(spark, sf_dir)))
    return rounded(mt.z_scores(features, list(FEATURES), ("event_key",)), 4)


@query
def timing_summary(spark, sf_dir):
    timings = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), (F.col("event_id") % 7 + 1).alias("rows"),
        F.col("value").alias("ms"))
    return rounded(mt.timing_summary(timings))


@query
def cost_comparison(spark, sf_dir):
    return rounded(mt.cost_comparison(table(spark, sf_dir, "events")), 4)


@query
def best_sweep_model(spark, sf_dir):
    """Of the verdicts at integrity levels, the one with the best F1."""
    sweep = mt.binary_metrics(judged_events(spark, sf_dir).withColumn(
        "model_id", t.nz(F.col("IntegrityLevel"))), by=("model_id",))
    return rounded(mt.best_by_f1(sweep))


@query
def keyed_predictions(spark, sf_dir):
    """Predictions from another table joined by key, those of an id list left out."""
    events = process_events(spark, sf_dir).select("event_key", "label")
    labels = table(spark, sf_dir, "labels")
    predictions = labels.select(F.col("doc_id").alias("event_key"),
                                F.col("toxic").alias("prediction"))
    dropped = labels.filter("quality = 0").select(F.col("doc_id").alias("event_key"))
    return lb.rows_with_ids(lb.attach_predictions(events, predictions), dropped, keep=False)


# ---- augmentation -------------------------------------------------------------------------------

@query
def augment_sample(spark, sf_dir):
    return sm.augment_dataset(process_events(spark, sf_dir), 0.5, 42).select(
        "event_key", "label", F.col("augmented").cast("int").alias("augmented"),
        "CommandLine", "Image", "SourceImage")


@query
def augment_folds(spark, sf_dir):
    """The changed copies that join the training side of each of five folds."""
    folded = sm.stratified_folds(process_events(spark, sf_dir))
    picked = sm.choose_for_folds(folded, 0.5, 5)
    return sm.augment(picked, F.lit(42) + F.col("for_fold")).select(
        "event_key", "fold", "for_fold", "CommandLine", "Image", "SourceImage")


# ---- explanations with fixed weights ---------------------------------------------------------------

# Fixed importance per feature, so that the result can be stated in SQL: a rule, no two alike.
WEIGHTS = {n: round(0.0201 + (i * 37 % len(FEATURES)) * 0.00137 + i * 1e-7, 7) for i, n in enumerate(FEATURES)}


def _contributions(spark, sf_dir, *keep: str) -> DataFrame:
    events = judged_events(spark, sf_dir)
    names = list(WEIGHTS)
    features = stored(features_of_batch(events, names, ["event_key", *keep]))
    statistics = mt.feature_statistics(features, names)
    return co.local_contributions(features, WEIGHTS, statistics, ["event_key", *keep])


@query
def local_contributions(spark, sf_dir):
    return rounded(co.long_contributions(_contributions(spark, sf_dir)))


@query
def drivers(spark, sf_dir):
    return _contributions(spark, sf_dir).select("event_key", "drivers")


@query
def attack_type(spark, sf_dir):
    return _contributions(spark, sf_dir).select(
        "event_key", co.infer_attack_type(F.col("top_features")).alias("attack_type"))


@query
def attack_scores(spark, sf_dir):
    return rounded(co.attack_scores(_contributions(spark, sf_dir)))


@query
def explanations(spark, sf_dir):
    """Explanation texts; the confidence is a fixed function of the rule score."""
    found = _contributions(spark, sf_dir, "prediction", "heuristic_score", "Image", "SourceImage",
                           "User")
    confident = found.withColumn(
        "confidence", F.least(F.lit(0.5) + F.col("heuristic_score") * 0.1, F.lit(0.99)))
    return co.with_explanation(confident).select("event_key", "explanation")


@query
def global_contributions(spark, sf_dir):
    """Mean |contribution| per feature over all events, with descriptions."""
    events = process_events(spark, sf_dir)
    names = list(WEIGHTS)
    features = stored(features_of_batch(events, names))
    statistics = mt.feature_statistics(features, names)
    items = F.array(*[c for _, _, c in co.contribution_items(WEIGHTS, statistics)])
    arrays = features.select(items.alias("items"))
    return rounded(co.global_importance(arrays, "items", names, 10))


# ---- models ---------------------------------------------------------------------------------------

def _table(spark, sf_dir, names=FEATURES) -> DataFrame:
    return stored(sc.labelled_features(process_events(spark, sf_dir), names))


@query
def forest_score(spark, sf_dir):
    features = _table(spark, sf_dir)
    model = fo.fit_forest(features, FEATURES, store=False)
    return fo.score(model, features, ["event_key", "label"]).select(
        "event_key", "label", "prediction", "confidence")


@query
def forest_quality(spark, sf_dir):
    """Rows scored, and whether the forest reaches the published quality band."""
    scored = forest_score(spark, sf_dir)
    return mt.binary_metrics(scored).select(
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("events"),
        (F.col("precision") >= 0.9).alias("precision_in_band"),
        (F.col("recall") >= 0.85).alias("recall_in_band"))


@query
def topk_refit(spark, sf_dir):
    features = _table(spark, sf_dir)
    model = fo.fit_top_k(features, FEATURES, 10, store=False)
    return fo.importance_table(spark, model)


@query
def mlp_score(spark, sf_dir):
    features = _table(spark, sf_dir)
    model = fo.fit_network(features, FEATURES, store=False)
    return fo.score_network(model, features, ["event_key", "label"])


@query
def soft_vote(spark, sf_dir):
    features = _table(spark, sf_dir)
    forest = fo.fit_forest(features, FEATURES, store=False)
    network = fo.fit_network(features, FEATURES, store=False)
    return fo.soft_vote(forest, network, features, ["event_key", "label"])


@query
def kfold_cv(spark, sf_dir):
    result = tn.cross_validate(process_events(spark, sf_dir), augment_share=0.5)
    return result.per_fold.select("fold", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall",
                                  "f1")


@query
def holdout_evaluation(spark, sf_dir):
    _, metrics, _ = tn.evaluate_holdout(process_events(spark, sf_dir))
    return metrics


@query
def tree_attributions(spark, sf_dir):
    """Events scored, and how many satisfy base + sum of attributions = probability."""
    features = _table(spark, sf_dir)
    model = fo.fit_forest(features, FEATURES, store=False)
    scored = fo.score(model, features, ["event_key"])
    found = ta.tree_attributions(scored, model, ("event_key", "p_malicious"))
    total = F.aggregate("attributions", F.col("base_value"), lambda acc, x: acc + x)
    return found.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.abs(total - F.col("p_malicious")) < 1e-9).alias("additive"))


@query
def global_attributions(spark, sf_dir):
    features = _table(spark, sf_dir)
    model = fo.fit_forest(features, FEATURES, store=False)
    scored = fo.score(model, features, ["event_key"])
    found = ta.tree_attributions(scored, model, ("event_key",))
    return co.global_importance(found, "attributions", model.names, 10)


@query
def exact_explanations(spark, sf_dir):
    """Verdict, exact attributions and explanation text of every event, benign verdicts too."""
    events = process_events(spark, sf_dir)
    model = tn.fit_final(events)
    return sc.explain_events(events, model, exact=True).select(
        "event_key", "prediction", "confidence", "explanation")


@query
def model_vs_reviewer(spark, sf_dir):
    events = process_events(spark, sf_dir)
    model = tn.fit_final(events)
    keep = ("event_key", "label", schema.TECHNIQUE_FIELD, schema.REVIEWER, "CommandLine")
    return cp.compare(sc.score_events(events, model, keep)).metrics


@query
def disagreement_model(spark, sf_dir):
    events = process_events(spark, sf_dir)
    model = tn.fit_disagreement_model(events)
    return tn.score_disagreement(events, model)


def _network_settings(features: DataFrame, epochs: int = 10) -> nw.NetworkSettings:
    """Eight steps an epoch whatever the size; the default of 32 rows a step suits some thousand rows."""
    return nw.NetworkSettings(epochs=epochs, batch=-(-features.count() // 8), rate=0.005)


@query
def adam_network(spark, sf_dir):
    """The network's verdict on events that it never saw, with what must hold for each."""
    table = stored(sc.labelled_features(sm.stratified_holdout(process_events(spark, sf_dir)), FEATURES, ("part",)), ("part",))
    train = table.filter(F.col("part") == "train")
    last = nw.fit_adam(train, FEATURES, _network_settings(train, 5))[-1].network
    scored = nw.as_pipeline(network=last).transform(table.filter(F.col("part") == "test"))
    p = F.col("p_malicious")
    return scored.select("event_key", "label", p.between(0, 1).alias("is_probability"),
                         ((F.col("prediction") == v.MALICIOUS) == (p > 0.5)).alias("called_by_half"),
                         (F.col("confidence") == F.greatest(p, 1 - p)).alias("sure_as_called"))


@query
def checkpoint_sweep(spark, sf_dir):
    """Snapshots of every fifth epoch on the hold-out, and whether the restored one is the best and scores as it did."""
    table = stored(sc.labelled_features(sm.stratified_holdout(process_events(spark, sf_dir)), FEATURES, ("part",)), ("part",))
    train, test = table.filter(F.col("part") == "train"), table.filter(F.col("part") == "test")
    snapshots = nw.fit_adam(train, FEATURES, _network_settings(train))
    swept = stored(nw.sweep(snapshots, test))
    restored = nw.as_pipeline(network=nw.restore_best(snapshots, swept)).transform(test)
    again = mt.binary_metrics(restored).select(F.col("f1").alias("again"))
    return swept.crossJoin(F.broadcast(again)).select(
        "epoch", (F.col("tp") + F.col("fn")).alias("malicious"), (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("tested"),
        (F.max("f1").over(Window.partitionBy()) == F.col("again")).alias("best_is_restored"))


def _without_parts(scored: DataFrame) -> DataFrame:
    """Scored rows without what a second model would add once more."""
    return scored.drop("p_forest", "p_network", "confidence")


@query
def saved_models(spark, sf_dir):
    """Network, vote and disagreement model saved, loaded, and held against what was saved, event by event."""
    events = process_events(spark, sf_dir)
    folder, table = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}", _table(spark, sf_dir)
    network = nw.fit_adam(table, FEATURES, _network_settings(table, 2))[-1].network
    forest = fo.fit_forest(table, FEATURES, store=False)
    disagreement = tn.fit_disagreement_model(events)
    other = stored(rr.disagreement_features(events, ("event_key",), FEATURES, with_mismatch=False))
    models = {"network": (nw.as_pipeline(network=network), table), "vote": (nw.as_pipeline(forest, network), table),
              "disagreement": (nw.as_pipeline(disagreement, classes=("agree", "differ")), other)}
    results = []
    for name, (model, rows) in models.items():
        model.write().overwrite().save(f"{folder}/{name}")
        loaded = PipelineModel.load(f"{folder}/{name}")
        one = _without_parts(model.transform(rows)).withColumnsRenamed({"prediction": "_as", "p_malicious": "_p"})
        results.append(loaded.transform(one).agg(  # the loaded model scores the same rows: they need not be joined
            F.count(F.lit(1)).alias("events"), F.count_if((F.col("p_malicious") == F.col("_p")) & (F.col("prediction") == F.col("_as"))).alias("equal")
        ).select(F.lit(name).alias("model"), "events", "equal"))
    return reduce(DataFrame.unionAll, results)


@query
def vote_is_mean(spark, sf_dir):
    """Per event, whether the vote is the mean of the two models scored alone."""
    table = _table(spark, sf_dir)
    forest = fo.fit_forest(table, FEATURES, store=False)
    network = nw.fit_adam(table, FEATURES, _network_settings(table, 2))[-1].network
    scored = nw.as_pipeline(forest, network).transform(table).withColumnsRenamed({"p_malicious": "_vote", "p_forest": "_forest", "p_network": "_network"})
    alone = fo.score(forest, scored, ["event_key", "_vote", "_forest", "_network"])  # of the same rows: they need not be joined
    return alone.select("event_key", F.col("_vote").alias("p_malicious"), F.col("_forest").alias("p_forest"),
                        F.col("_network").alias("p_network"), F.col("p_malicious").alias("alone")).select(
        "event_key", (F.abs(F.col("p_malicious") - (F.col("p_forest") + F.col("p_network")) / 2) < 1e-12).alias("is_mean"),
        (F.col("alone") == F.col("p_forest")).alias("forest_as_alone"), F.col("p_network").between(0, 1).alias("is_probability"))


# One tree of one split over integer features: the fit is deterministic and SQL can state it.
STUMP = ("native_binary_abuse_score", "apt_lotl_score", "cmdline_word_count", "num_slashes", "num_quotes",
         "image_path_depth", "execution_context_risk")
STUMP_SHAPE = fo.ForestSettings(trees=1, depth=1, bootstrap=False)


def _stump(spark, sf_dir):
    features = _table(spark, sf_dir, STUMP)
    return features, fo.fit_forest(features, STUMP, STUMP_SHAPE, store=False)


@query
def stump_score(spark, sf_dir):
    features, model = _stump(spark, sf_dir)
    return rounded(fo.score(model, features, ["event_key", "label"]).select(
        "event_key", "label", "prediction", "confidence", "p_malicious"))


@query
def stump_importance(spark, sf_dir):
    _, model = _stump(spark, sf_dir)
    return rounded(fo.importance_table(spark, model))


@query
def stump_top_feature(spark, sf_dir):
    """Refit on the most important feature alone."""
    features = _table(spark, sf_dir, STUMP)
    model = fo.fit_top_k(features, STUMP, 1, STUMP_SHAPE, store=False)
    return rounded(fo.score(model, features, ["event_key"]).select("event_key", "prediction", "p_malicious"))


@query
def stump_attributions(spark, sf_dir):
    """Exact attributions of every event and feature."""
    features, model = _stump(spark, sf_dir)
    scored = fo.score(model, features, ["event_key"])
    found = ta.tree_attributions(scored, model, ("event_key",))
    return rounded(found.select("event_key", "base_value", F.posexplode("attributions").alias("i", "contribution")).select(
        "event_key", F.get(F.array(*[F.lit(n) for n in model.names]), F.col("i")).alias("feature"),
        "base_value", "contribution"))


@query
def stump_kfold(spark, sf_dir):
    """Per-fold metrics of five folds, each judged by a tree fitted on the other four."""
    result = tn.cross_validate(process_events(spark, sf_dir), settings=STUMP_SHAPE, names=STUMP)
    return rounded(result.per_fold.select("fold", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1"))


@query
def stump_pooled(spark, sf_dir):
    """Metrics over the out-of-fold predictions of all events."""
    result = tn.cross_validate(process_events(spark, sf_dir), settings=STUMP_SHAPE, names=STUMP)
    return rounded(result.overall)


@query
def stump_holdout(spark, sf_dir):
    _, metrics, _ = tn.evaluate_holdout(process_events(spark, sf_dir), settings=STUMP_SHAPE, names=STUMP)
    return rounded(metrics)


@query
def stump_vs_reviewer(spark, sf_dir):
    """Metrics of the tree and of the reviewer side by side."""
    events = process_events(spark, sf_dir)
    model = tn.fit_final(events, settings=STUMP_SHAPE, names=STUMP)
    keep = ("event_key", "label", schema.TECHNIQUE_FIELD, schema.REVIEWER, "CommandLine")
    return rounded(cp.compare(sc.score_events(events, model, keep)).metrics)


@query
def stream_stump(spark, sf_dir):
    """The tree's verdicts as a streaming job that drains the table."""
    model = tn.fit_final(process_events(spark, sf_dir), settings=STUMP_SHAPE, names=STUMP)
    scores = st.score_stream(event_stream(spark, sf_dir), model, contributions=False)
    return rounded(_drained(spark, scores).select("event_key", "prediction", "confidence"))


@query
def feature_table_rows(spark, sf_dir):
    """All 103 columns of every event."""
    return rounded(features_of_batch(process_events(spark, sf_dir), keep=("event_key", "label")), 4)


@query
def feature_table_by_commands(spark, sf_dir):
    """The same with what follows from a command computed once per command."""
    return rounded(feature_table_by_command(process_events(spark, sf_dir), keep=("event_key", "label")), 4)


# ---- streaming ------------------------------------------------------------------------------------

def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events")
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(*READ)
    tasks = tasks_of(spark, source.count())  # a micro-batch is read by as few tasks as the table
    return as_process_events(rows.repartition(tasks) if tasks > 1 else rows)


def _drained(spark: SparkSession, scores: DataFrame) -> DataFrame:
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    running = st.write_scores(scores, f"{folder}/scores", f"{folder}/checkpoint")
    running.awaitTermination()
    return spark.read.schema(scores.schema).parquet(f"{folder}/scores")


@query
def stream_heuristic(spark, sf_dir):
    """The rule-based verdict as a streaming job that drains the table."""
    return _drained(spark, st.heuristic_stream(event_stream(spark, sf_dir)))


@query
def stream_score(spark, sf_dir):
    model = tn.fit_final(process_events(spark, sf_dir))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    st.write_scored_batches(event_stream(spark, sf_dir), folder, f"{folder}/checkpoint",
                            lambda batch: st.score_stream(batch, model)).awaitTermination()
    return st.read_batches(spark, folder, "scores").select("event_key", "prediction", "confidence", "drivers")


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events as JSON text, fields under both spellings; every 997th line is cut short."""
    raw = raw_process_events(spark, sf_dir)
    spelled = {schema.alt(f): s for f, s in schema.SPELLINGS.items()} | {schema.REVIEWER: schema.REVIEWER_SOURCE_FIELD}
    line = F.to_json(F.struct(*[F.col(f"`{c}`").alias(spelled.get(c, c)) for c in raw.columns]))
    return raw.select("event_key", F.when(F.col("event_key") % 997 == 5, F.substring(line, 1, 20)).otherwise(line).alias("value"))


@query
def stream_json(spark, sf_dir):
    """Events as JSON lines through a stream with two sinks, in batches of a file, stopped and resumed."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    lines = _json_lines(spark, sf_dir)
    for part in (0, 1):  # the second run finds the checkpoint of the first and the files that came since
        lines.filter(F.pmod("event_key", F.lit(2)) == part).select("value").repartition(3).write.mode("append").text(f"{folder}/in")
        st.score_json_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", st.heuristic_stream,
                             files_per_trigger=1, extra={"event_key": "bigint"}).awaitTermination()
    scores = st.read_batches(spark, f"{folder}/out", "scores").select(
        "event_key", "heuristic_score", "heuristic_verdict", F.lit(None).cast("string").alias("bad_line"))
    return scores.unionByName(st.read_batches(spark, f"{folder}/out", "bad_lines").select(
        F.lit(None).cast("long").alias("event_key"), F.lit(None).cast(scores.schema["heuristic_score"].dataType).alias("heuristic_score"),
        F.lit(None).cast("string").alias("heuristic_verdict"), F.col("line").alias("bad_line")))


@query
def single_event_latency(spark, sf_dir):
    """Ten events of the table, each a trigger of its own: how many were timed, and whether the times make sense."""
    folder = f"{shared_folder(spark)}/latency-{uuid.uuid4().hex}"
    timings = st.single_event_timings(spark, process_events(spark, sf_dir), folder, st.heuristic_stream)
    return mt.timing_summary(timings).select(
        "stage", "runs", ((F.col("min_ms") > 0) & (F.col("min_ms") <= F.col("mean_ms")) & (F.col("mean_ms") <= F.col("max_ms"))).alias("ordered"))


# ---- sinks and readers ------------------------------------------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def json_events_read_back(spark, sf_dir):
    """Raw events written as JSON lines under both spellings, read with the declared schema and resolved."""
    folder = _folder(spark, "events")
    raw = raw_process_events(spark, sf_dir)
    spelled = {schema.alt(f): s for f, s in schema.SPELLINGS.items()} | {schema.REVIEWER: schema.REVIEWER_SOURCE_FIELD}
    raw.select(F.to_json(F.struct(*[F.col(f"`{c}`").alias(spelled.get(c, c)) for c in raw.columns]))).write.text(folder)
    events = pr.prepare_events(read_events(spark, folder, spellings=True, extra={"event_key": "bigint"}), ("event_key",))
    return events.select("event_key", *SHOWN)


@query
def disagreement_csv_read_back(spark, sf_dir):
    folder = _folder(spark, "csv")
    sinks.write_disagreement_csv(process_events(spark, sf_dir), folder, "label")
    rows = spark.read.option("header", True).option("escape", '"').csv(folder)
    return rows.select(F.get_json_object(schema.REVIEWER, "$.predicted_label").alias("reviewer_label"),
                       F.get_json_object(schema.REVIEWER, "$.reason").alias("reason"), "label",
                       F.coalesce(schema.TECHNIQUE_FIELD, F.lit("")).alias("technique"))


@query
def failure_files_read_back(spark, sf_dir):
    """The three files of a triage run, read again."""
    folder = _folder(spark, "triage")
    cp.write_failure_analysis(cp.analyze_failures(judged_events(spark, sf_dir)), folder)
    fields = "event_key long, ground_truth string, command_line string, image string, user string, model_prediction string, failure_pattern string"
    parts = [spark.read.schema(fields).json(f"{folder}/{name}").withColumn("file", F.lit(name))
             for name in ("less_than_reviewer", "better_than_reviewer", "failure_patterns")]
    return reduce(DataFrame.unionAll, parts)


@query
def nested_events_read_back(spark, sf_dir):
    """Disagreements with their event as a nested object."""
    folder = _folder(spark, "nested")
    sinks.write_json_lines(lb.prediction_disagreements(judged_events(spark, sf_dir)), folder)
    rows = spark.read.schema("event_key long, ground_truth string, event struct<CommandLine string, ProcessId bigint, User string>").json(folder)
    return rows.select("event_key", "ground_truth", "event.CommandLine", "event.ProcessId", "event.User")


@query
def validation_read_back(spark, sf_dir):
    """Fold results written with the settings of the run, read again."""
    folder = _folder(spark, "folds")
    result = tn.cross_validate(process_events(spark, sf_dir), settings=STUMP_SHAPE, names=STUMP)
    tn.write_validation(result, folder, folds=5, seed=42)
    fields = "fold int, tp long, fp long, tn long, fn long, accuracy double, precision double, recall double, f1 double"
    settings = spark.read.schema("setting string, value string").json(f"{folder}/config").groupBy().agg(
        F.sort_array(F.collect_list(F.concat("setting", F.lit("="), "value"))).alias("s"))
    return rounded(spark.read.schema(fields).json(f"{folder}/folds")).crossJoin(F.broadcast(settings.select(
        F.array_join("s", ",").alias("settings"))))


@query
def evaluation_read_back(spark, sf_dir):
    """Hold-out metrics and cost, written and read again."""
    folder = _folder(spark, "evaluation")
    _, metrics, cost = tn.evaluate_holdout(process_events(spark, sf_dir), settings=STUMP_SHAPE, names=STUMP)
    sinks.write_results(folder, metrics=metrics, cost=cost)
    fields = "tp long, fp long, tn long, fn long, accuracy double, precision double, recall double, f1 double"
    return rounded(spark.read.schema(fields).json(f"{folder}/metrics"))


@query
def first_events(spark, sf_dir):
    """The ten latest events; of one time the smaller key."""
    return sm.first_rows(table(spark, sf_dir, "events"), 10, F.desc("ts"), "event_id").select("event_id", "user_id", "event_type")


# ---- models of one split, explained ------------------------------------------------------------------

@query
def stump_global_attributions(spark, sf_dir):
    """Mean size of the exact attributions per feature, with descriptions."""
    features, model = _stump(spark, sf_dir)
    found = ta.tree_attributions(fo.score(model, features, ["event_key"]), model, ("event_key",))
    return rounded(co.global_importance(found, "attributions", model.names, 10))


@query
def stump_explanations(spark, sf_dir):
    """Verdict, exact attributions and explanation text of every alert."""
    events = process_events(spark, sf_dir)
    model = tn.fit_final(events, settings=STUMP_SHAPE, names=STUMP)
    return rounded(sc.explain_events(events, model, exact=True, alerts_only=True).select(
        "event_key", "prediction", "confidence", "explanation"))


@query
def disagreement_training(spark, sf_dir):
    """The rows a disagreement model is fitted on."""
    return tn.disagreement_training_rows(process_events(spark, sf_dir)).select("event_key", F.col("_target").cast("int").alias("differ"))


@query
def disagreement_stump(spark, sf_dir):
    """A disagreement model of one split, over base and reviewer features."""
    events = process_events(spark, sf_dir)
    model = tn.fit_disagreement_model(events, settings=STUMP_SHAPE, base=STUMP)
    return rounded(tn.score_disagreement(events, model, base=STUMP))
