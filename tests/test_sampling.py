"""Hold-outs, folds and augmentation."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from groundtrace.functions.hashing import order_hash
from groundtrace.operators import sampling as sm


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(1000)] + [(2000 + i, "c") for i in range(3)] + [(3000, None)]
    return spark.createDataFrame(rows, "event_key long, label string").persist()


@pytest.mark.parametrize("digits", [1, 3])
def test_folds_equal_the_window_form(labelled, digits):
    order = sm.Order(42, prefix_digits=digits)
    got = sm.stratified_folds(labelled, 5, order)
    window = Window.partitionBy("label").orderBy(order_hash(42, F.col("event_key")), F.col("event_key").cast("string"))
    both = got.withColumn("want", F.ntile(5).over(window))
    assert both.filter("fold <> want").count() == 0
    assert both.count() == labelled.count()


def test_fold_sizes_differ_by_at_most_one(labelled):
    sizes = sm.stratified_folds(labelled, 7).filter("label <> 'c'").groupBy("label", "fold").count()
    spans = sizes.groupBy("label").agg((F.max("count") - F.min("count")).alias("d"), F.count("*").alias("k"))
    assert all(r["d"] <= 1 and r["k"] == 7 for r in spans.collect())


def test_fold_assignment_does_not_shuffle_rows(labelled):
    plan = sm.stratified_folds(labelled)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_holdout_sizes(labelled):
    parts = sm.stratified_holdout(labelled, 0.2).groupBy("label", "part").count().collect()
    sizes = {(r["label"], r["part"]): r["count"] for r in parts}
    for label, n in (("a", 666), ("b", 334), ("c", 3)):
        train = int(n * (1 - 0.2))
        assert sizes.get((label, "train"), 0) == train
        assert sizes[(label, "test")] == n - train
    # one row of a null label: floor(0.8) = 0 rows of training
    assert sizes[(None, "test")] == 1


def test_one_key_with_a_third_of_all_rows(spark):
    rows = spark.range(600).select("id", F.lit("x").alias("label")).union(
        spark.range(300).select(F.lit(7).cast("long"), F.lit("x")))
    keyed = rows.withColumnRenamed("id", "event_key")
    folded = sm.stratified_folds(keyed, 3, sm.Order(together=True))
    assert folded.count() == 900
    assert folded.filter("event_key = 7").select("fold").distinct().count() == 1  # copies stay together


def test_choose(labelled):
    order = sm.Order(1, "s", stratum=None)
    assert sm.choose(labelled, 0.25, order).count() == 251
    assert sm.choose(labelled, 0.0, order).count() == 0
    assert sm.choose_count(labelled, 10, order).count() == 10
    assert sm.choose_count(labelled, 5000, order).count() == labelled.count()
    again = sm.choose(labelled.repartition(7), 0.25, order)
    assert sm.choose(labelled, 0.25, order).exceptAll(again).count() == 0
    share = sm.choose(labelled, 0.25, order, "hash").count() / labelled.count()
    assert 0.15 < share < 0.35


def test_fifty_thousand_strata(spark):
    many = spark.range(150_000).select(F.col("id").alias("event_key"), (F.col("id") % 50_000).alias("label"))
    parts = sm.stratified_holdout(many, 1 / 3).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 100_000, "test": 50_000}


def test_large_cells_are_counted_deeper(labelled, monkeypatch):
    once = sm.stratified_folds(labelled, 5)
    monkeypatch.setattr(sm, "CELL_ROWS", 3)
    deeper = sm.stratified_folds(labelled, 5, sm.Order(prefix_digits=1))
    assert once.exceptAll(deeper).isEmpty()


def test_null_keys_are_refused(spark):
    rows = spark.range(100).select(F.when(F.col("id") >= 40, F.col("id")).alias("event_key"), F.lit("x").alias("label"))
    with pytest.raises(Exception, match="null event_key"):
        sm.stratified_folds(rows, 5).count()


def test_cuts_inside_one_key_are_refused(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("event_key"), F.lit("x").alias("label"))
    for run in (lambda: sm.stratified_folds(rows, 5), lambda: sm.choose(rows, 0.5, sm.Order(1, stratum=None))):
        with pytest.raises(Exception, match="inside the rows of one event_key"):
            run().count()
    whole = sm.stratified_folds(rows, 5, sm.Order(together=True))
    assert whole.select("event_key", "fold").distinct().count() == 3


def test_augmented_copies(events):
    both = sm.augment_dataset(events, 0.5, 3)
    copies = both.filter("augmented")
    assert copies.count() == events.count() // 2
    assert both.count() == events.count() + copies.count()
    pairs = copies.alias("c").join(events.alias("o"), "event_key")
    changed = pairs.filter(~F.col("c.CommandLine").eqNullSafe(F.col("o.CommandLine")))
    assert changed.count() > 0
    squeezed = F.regexp_replace(F.lower(F.trim(F.col("c.CommandLine"))), r"\s+", " ")
    original = F.regexp_replace(F.lower(F.trim(F.col("o.CommandLine"))), r"\s+", " ")
    assert changed.filter(squeezed != original).count() == 0
    assert pairs.filter(F.col("c.label") != F.col("o.label")).count() == 0
    assert pairs.filter(F.replace(F.col("c.Image"), F.lit("/"), F.lit("\\")) != F.col("o.Image")).count() == 0


def jobs_of(spark, run):
    group = f"count-{id(run)}"
    spark.sparkContext.setJobGroup(group, "counted")
    result = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_choices_for_all_folds_in_one_pass(spark, events):
    jobs = []
    for folds in (3, 7):
        folded = sm.stratified_folds(events, folds).select("event_key", "label", "fold").persist()
        folded.count()
        (picked, n) = jobs_of(spark, lambda: sm.choose_for_folds(folded, 0.5, folds, 42).collect())
        jobs.append(n)
        for f in range(1, folds + 1):
            alone = sm.choose(folded.filter(F.col("fold") != f), 0.5, sm.Order(42 + f, "augment", stratum=None)).collect()
            assert sorted(r.event_key for r in picked if r.for_fold == f) == sorted(r.event_key for r in alone)
    assert jobs[0] == jobs[1]


def test_changes_follow_the_seed_of_the_fold(spark, events):
    rows = events.limit(200)
    by_column = sm.augment(rows.withColumn("s", F.lit(40) + 3), F.col("s")).drop("s")
    assert by_column.exceptAll(sm.augment(rows, 43)).count() == 0
