"""The network: gradients, sums that no partitioning changes, dropout, the sweep, saving and loading."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from groundtrace.operators import forest as fo
from groundtrace.operators import network as nw
from groundtrace.operators.metrics import best_by_f1
from groundtrace.plans import scoring, training

NAMES = ("cmdline_length", "num_dashes", "native_binary_abuse_score", "apt_lotl_score", "cmdline_entropy", "num_slashes")
SMALL = nw.NetworkSettings(hidden=(8, 4), epochs=4, batch=100, rate=0.01, every=2)


@pytest.fixture(scope="module")
def features(spark, events):
    return scoring.labelled_features(events, NAMES).persist()


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(3)
    layers = [5, 7, 4, 2]
    weights = nw.initial_weights(layers, 1)
    x, y = rng.normal(size=(90, 5)), rng.integers(0, 2, 90)
    masks = [nw.dropout_mask(np.arange(90), n, 5, 0.3) for n in layers[1:-1]]
    loss, sums = nw.gradient_sums(x, y, weights, masks, grid=0)
    flat, step = nw._flat(weights), 1e-6
    for at in rng.choice(len(flat), 40, replace=False):
        sides = []
        for sign in (1, -1):
            moved = flat.copy()
            moved[at] += sign * step
            sides.append(nw.gradient_sums(x, y, nw._shaped(moved, layers), masks, grid=0)[0])
        assert abs((sides[0] - sides[1]) / (2 * step) - nw._flat(sums)[at]) < 1e-4
    _, coarse = nw.gradient_sums(x, y, weights, masks)
    assert np.abs(nw._flat(coarse) - nw._flat(sums)).max() < 90 * 4 * nw.GRID


def test_sums_are_exact_in_any_order():
    rng = np.random.default_rng(5)
    weights = nw.initial_weights([6, 9, 2], 2)
    x, y, keys = rng.normal(size=(1000, 6)) * 5, rng.integers(0, 2, 1000), rng.integers(0, 2 ** 62, 1000)

    def total(order, cuts):
        parts = np.split(order, cuts)
        return sum(nw._flat(nw.gradient_sums(x[p], y[p], weights, [nw.dropout_mask(keys[p], 9, 3, 0.3)])[1]) for p in parts if len(p))

    whole = total(np.arange(1000), [])
    for _ in range(5):
        assert (total(rng.permutation(1000), np.sort(rng.integers(0, 1000, 6))) == whole).all()


def test_dropout_share():
    mask = nw.dropout_mask(np.random.default_rng(0).integers(0, 2 ** 62, 4000), 50, 7, 0.3)
    assert abs((mask == 0).mean() - 0.3) < 0.01 and set(np.unique(mask)) == {0, 1 / 0.7}
    again = nw.dropout_mask(np.random.default_rng(0).integers(0, 2 ** 62, 4000), 50, 8, 0.3)
    assert 0.5 < (mask == again).mean() < 0.65
    assert (nw.dropout_mask(np.arange(3), 2, 0, 0.0) == 1).all()


def test_any_partitioning_gives_the_same_network(features):
    one = nw.fit_adam(features.repartition(1), NAMES, SMALL)
    many = nw.fit_adam(features.repartition(9, F.rand(1)), NAMES, SMALL)
    assert [s.epoch for s in one] == [2, 4]
    assert (nw._flat(one[-1].network.weights) == nw._flat(many[-1].network.weights)).all()
    assert one[-1].loss < one[0].loss


def test_sweep_and_restore(spark, features):
    snapshots = nw.fit_adam(features, NAMES, nw.NetworkSettings(hidden=(8,), epochs=5, batch=200, rate=0.02, every=2))
    swept = nw.sweep(snapshots, features)
    rows = {r.epoch: r for r in swept.collect()}
    assert sorted(rows) == [2, 4, 5]
    for s in snapshots:
        scored = nw.as_pipeline(network=s.network).transform(features)
        hits = scored.filter((F.col("label") == "malicious") & (F.col("prediction") == "malicious")).count()
        assert rows[s.epoch].tp == hits
    best = max(rows.values(), key=lambda r: (r.f1, -r.epoch))
    assert best_by_f1(swept).first()["model_id"] == best.model_id
    restored = nw.restore_best(snapshots, swept)
    assert restored is next(s.network for s in snapshots if s.epoch == best.epoch)


def test_save_and_load(spark, events, features, tmp_path):
    network = nw.fit_adam(features, NAMES, nw.NetworkSettings(hidden=(8,), epochs=1, batch=300))[-1].network
    forest = fo.fit_forest(features, NAMES[:4])
    differ = training.fit_disagreement_model(events, base=NAMES)
    for name, model, rows in (("network", nw.as_pipeline(network=network), features), ("vote", nw.as_pipeline(forest, network), features),
                              ("differ", nw.as_pipeline(differ, classes=("agree", "differ")), training.disagreement_features(events, ("event_key",), NAMES))):
        path = str(tmp_path / name)
        model.write().overwrite().save(path)
        loaded = PipelineModel.load(path)
        shown = ["event_key", "prediction", "confidence", "p_malicious"]
        first, second = model.transform(rows).select(shown), loaded.transform(rows).select(shown)
        assert first.count() == events.count() and first.exceptAll(second).count() == 0
    assert {r[0] for r in second.select("prediction").distinct().collect()} <= {"agree", "differ"}


def test_odd_tables(spark, features):
    one_class = features.filter("label = 'benign'").limit(30)
    assert nw.fit_adam(one_class, NAMES, nw.NetworkSettings(hidden=(4,), epochs=1, batch=1000))[0].epoch == 1
    holes = features.limit(20).withColumn("num_dashes", F.lit(None).cast("int"))
    network = nw.fit_adam(features.limit(60), NAMES, nw.NetworkSettings(hidden=(4,), epochs=1))[-1].network
    scored = nw.as_pipeline(network=network).transform(holes)
    assert scored.filter("p_malicious BETWEEN 0 AND 1").count() == 20
    assert nw.as_pipeline(network=network).transform(holes.limit(0)).count() == 0


def test_a_large_mini_batch_is_read_by_several_tasks(spark):
    """Rows lie in the order of their mini-batch: those of one must not all fall to one task."""
    from groundtrace.session import FEWEST

    rows = 8 * FEWEST
    table = spark.range(rows).select(F.col("id").alias("event_key"), (F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"),
                                     F.when(F.col("id") % 2 == 0, "benign").otherwise("malicious").alias("label"))
    placed, batches, _ = nw._prepared(table, ("a", "b"), "event_key", nw.NetworkSettings(batch=rows // 2))
    assert batches == 2 and placed.select("k").distinct().count() == rows
    for part in range(batches):
        one = placed.filter(F.col("part") == part)
        sizes = [r["count"] for r in one.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 3 and max(sizes) <= 3 * FEWEST
