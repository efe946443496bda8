"""Exact additive attributions of a forest's probability per event.

A leaf contributes to a prediction through the distinct features on its path. Each such feature has an
interval the value must lie in and a cover ratio (share of the training weight that follows the path at
its splits). Whether the row lies in each interval gives a bit pattern, and the Shapley shares of the
leaf depend on the row through that pattern only. The shares of the patterns that occur in an Arrow batch come from
the polynomial whose coefficients sum over the subsets of each size: its product over all features once, then one
feature divided out at a time. So a leaf costs O(depth^2) per pattern, whatever the depth, without any shuffle.
"""

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundtrace.operators.forest import ForestModel
from groundtrace.session import shared_folder

@dataclass(frozen=True)
class Leaf:
    tree: int
    leaf: int
    features: np.ndarray  # distinct feature positions on the path
    low: np.ndarray       # the value must be > low ...
    high: np.ndarray      # ... and <= high
    ratios: np.ndarray    # cover ratio of each feature
    probability: float    # share of the leaf in the forest's probability


def forest_nodes(spark: SparkSession, model: ForestModel) -> list[dict]:
    """The nodes of the forest, read from its saved form; their number is known and small."""
    import uuid

    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.forest.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("threshold"))
    rows = nodes.limit(model.forest.totalNumNodes + 1).collect()
    return [r.asDict() for r in rows]


def _shares(ratios: np.ndarray, probability: float, inside: np.ndarray) -> np.ndarray:
    """Shapley shares [pattern, feature] of one leaf for in/out patterns of its path features."""
    d = len(ratios)
    inside = inside.astype(float)
    # Coefficient s: sum over the sets of s features of in-bits inside, ratios outside.
    product = np.zeros((len(inside), d + 1))
    product[:, 0] = 1.0
    for j in range(d):
        grown = product * ratios[j]
        grown[:, 1:] += product[:, :-1] * inside[:, [j]]
        product = grown
    weights = np.array([1.0 / (d * comb(d - 1, s)) for s in range(d)])
    # Divide out (ratio + in * z) for every feature at once: from the top where the in-bit is set, else by the ratio.
    total, above = np.zeros((len(inside), d)), np.zeros((len(inside), d))
    for s in range(d - 1, -1, -1):
        above = product[:, [s + 1]] - ratios * above
        total += weights[s] * np.where(inside > 0, above, product[:, [s]] / ratios)
    return total * (inside - ratios) * probability


def leaf_patterns(spark: SparkSession, model: ForestModel) -> tuple[list[Leaf], float]:
    """All leaves with their paths, and the base value (expected probability of the forest)."""
    trees: dict[int, dict[int, dict]] = {}
    for node in forest_nodes(spark, model):
        trees.setdefault(node["treeID"], {})[node["id"]] = node
    leaves, base = [], 0.0

    def weight(node) -> float:
        return float(sum(node["impurityStats"]))

    for tree, nodes in sorted(trees.items()):
        pending = [(nodes[0], {})]
        while pending:
            node, path = pending.pop()
            if node["leftChild"] < 0:
                p = node["impurityStats"][1] / weight(node) / len(trees)
                features = sorted(path)
                ratios = np.array([path[f][2] for f in features])
                base += p * float(np.prod(ratios))
                if features:
                    leaves.append(Leaf(
                        tree, node["id"], np.array(features),
                        np.array([path[f][0] for f in features]),
                        np.array([path[f][1] for f in features]), ratios, p))
                continue
            feature, cut = node["feature"], float(node["threshold"][0])
            low, high, ratio = path.get(feature, (-np.inf, np.inf, 1.0))
            for child, interval in ((nodes[node["leftChild"]], (low, min(high, cut))),
                                    (nodes[node["rightChild"]], (max(low, cut), high))):
                share = ratio * weight(child) / weight(node)
                pending.append((child, {**path, feature: (*interval, share)}))
    return leaves, base


def alike(values: np.ndarray, leaves: list[Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """(first, back): a row of each group of rows that no split tells apart, and the group of every row."""
    cuts: dict[int, set[float]] = {}
    for leaf in leaves:
        for f, low, high in zip(leaf.features, leaf.low, leaf.high):
            cuts.setdefault(int(f), set()).update(x for x in (low, high) if np.isfinite(x))
    group, groups = np.zeros(len(values), np.int64), 1
    for f, found in sorted(cuts.items()):
        place = np.searchsorted(np.array(sorted(found)), values[:, f], side="left")  # NaN comes last, beyond every cut
        place[np.isnan(values[:, f])] = len(found) + 1
        width = len(found) + 2
        if groups > 2 ** 62 // width:
            _, group = np.unique(group, return_inverse=True)
            groups = int(group.max(initial=0)) + 1
        group, groups = group * width + place, groups * width
    _, first, back = np.unique(group, return_index=True, return_inverse=True)
    return first, back.reshape(-1)


def attribute(values: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Attributions [row, feature] of a block of feature rows; rows that no split tells apart are computed once."""
    first, back = alike(values, leaves)
    return _attribute(values[first], leaves)[back]


def _attribute(values: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    result = np.zeros_like(values)
    for leaf in leaves:
        x = values[:, leaf.features]
        inside = (x > leaf.low) & (x <= leaf.high)
        patterns, back = np.unique(np.packbits(inside, axis=1), axis=0, return_inverse=True)
        bits = np.unpackbits(patterns, axis=1, count=inside.shape[1])
        result[:, leaf.features] += _shares(leaf.ratios, leaf.probability, bits)[back.reshape(-1)]
    return result


def _with_attributions(scored: DataFrame, model: ForestModel, keep: tuple[str, ...],
                       added: T.StructType, build) -> DataFrame:
    """keep columns plus what ``build(values, attributions, base)`` returns for each Arrow batch."""
    spark = scored.sparkSession
    leaves, base = leaf_patterns(spark, model)
    tables = spark.sparkContext.broadcast(leaves)
    width = len(model.names)
    ready = scored.select(*keep, F.array(*[F.col(n).cast("double") for n in model.names])
                          .alias("_x"))
    schema = T.StructType([*ready.drop("_x").schema, *added])

    def blocks(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("_x"))
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            new = build(values, attribute(values, tables.value), base)
            yield pa.RecordBatch.from_arrays([*kept, *new], names=schema.names)

    return ready.mapInArrow(blocks, schema)


def _lists(values: pa.Array, rows: int, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), values)


def tree_attributions(scored: DataFrame, model: ForestModel, keep: tuple[str, ...]) -> DataFrame:
    """keep columns, ``base_value`` and ``attributions`` (array<double> in feature order)."""
    added = T.StructType().add("base_value", T.DoubleType()).add(
        "attributions", T.ArrayType(T.DoubleType()))

    def build(values, phi, base):
        rows, width = phi.shape
        return [pa.array(np.full(rows, base)), _lists(pa.array(phi.ravel()), rows, width)]

    return _with_attributions(scored, model, keep, added, build)


def top_attributions(scored: DataFrame, model: ForestModel, keep: tuple[str, ...], k: int = 5
                     ) -> DataFrame:
    """keep columns and ``top_features``: the k largest attributions, the earlier feature on a tie."""
    item = T.StructType().add("name", T.StringType()).add("value", T.DoubleType()).add(
        "contribution", T.DoubleType())
    added = T.StructType().add("top_features", T.ArrayType(item))
    names = np.array(model.names)

    def build(values, phi, base):
        rows, width = len(phi), min(k, phi.shape[1])
        best = np.argsort(-np.abs(phi), axis=1, kind="stable")[:, :width]
        fields = [pa.array(names[best.ravel()].tolist(), pa.string()),
                  pa.array(np.take_along_axis(values, best, 1).ravel()),
                  pa.array(np.take_along_axis(phi, best, 1).ravel())]
        items = pa.StructArray.from_arrays(fields, ["name", "value", "contribution"])
        return [_lists(items, rows, width)]

    return _with_attributions(scored, model, keep, added, build)


def tree_attributions_by_join(scored: DataFrame, model: ForestModel, key: str = "event_key"
                              ) -> DataFrame:
    """The same attributions as (key, feature, contribution) from joins only.

    Every event meets every leaf once and every pattern is listed, so this form is for checks of shallow forests.
    """
    spark = scored.sparkSession
    leaves, _ = leaf_patterns(spark, model)

    def every(d: int) -> np.ndarray:
        return (np.arange(1 << d)[:, None] >> np.arange(d)) & 1

    rows = [(n, p, model.names[f], float(share[j])) for n, leaf in enumerate(leaves)
            for p, share in enumerate(_shares(leaf.ratios, leaf.probability, every(len(leaf.ratios))))
            for j, f in enumerate(leaf.features)]
    table = spark.createDataFrame(rows, "_leaf int, _pattern int, feature string, share double")
    x = F.array(*[F.col(n).cast("double") for n in model.names])
    listed = F.array(*[F.struct(
        F.lit(n).alias("_leaf"),
        F.array(*[F.struct(F.lit(int(f)).alias("at"), F.lit(float(lo)).alias("low"),
                           F.lit(float(hi)).alias("high"), F.lit(1 << j).alias("bit"))
                  for j, (f, lo, hi) in enumerate(zip(leaf.features, leaf.low, leaf.high))])
        .alias("_path")) for n, leaf in enumerate(leaves)])
    met = scored.select(key, x.alias("_x"), F.inline(listed))
    pattern = F.aggregate("_path", F.lit(0), lambda acc, s: acc + F.when(
        (F.get(F.col("_x"), s["at"]) > s["low"]) & (F.get(F.col("_x"), s["at"]) <= s["high"]),
        s["bit"]).otherwise(0))
    matched = met.select(key, "_leaf", pattern.alias("_pattern")).join(
        table, ["_leaf", "_pattern"])
    return matched.groupBy(key, "feature").agg(F.sum("share").alias("contribution"))
