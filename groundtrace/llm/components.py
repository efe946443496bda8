"""Connected components of an edge table: stars of the edges in each task, then alternating star operations."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace.llm.tables import Work

EDGES = 1 << 16  # edges that one task takes at once, on average


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def _contract(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (u, v) that connect the same nodes: those of each of so many tasks as stars, v the smallest node of a part."""
    def run(batches):
        parts = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches if batch.num_rows]
        if not parts:
            return
        nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        top = np.arange(len(nodes))
        while (top[a] != top[b]).any():
            np.minimum.at(top, np.maximum(top[a], top[b]), np.minimum(top[a], top[b]))
            while (top[top] != top).any():
                top = top[top]
        moved = top != np.arange(len(nodes))
        yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[top[moved]])], names=["u", "v"])

    return edges.repartition(tasks).mapInArrow(run, "u long, v long")


def _rounds(now: DataFrame, work: Work, max_rounds: int) -> DataFrame:
    """The edges as one star per component. Each round first hangs every node's larger neighbours on its smallest
    neighbour (large star), then all smaller neighbours and the node itself (small star), and stores the edges; a few
    rounds turn every component into one star, also long chains. Minima are partly aggregated before the shuffle, so a
    hub is no hot spot there, and the joins may split it.
    """
    state = _state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = work.store(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        moved = large.join(least, F.col("u") == F.col("k")).filter("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        following = work.store(moved.unionByName(
            least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        work.drop(now, large)
        now, before, state = following, state, _state(following)
        if state == before:
            return now
    raise RuntimeError(f"components not found in {max_rounds} rounds")


def components(edges: DataFrame, work: Work, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (``a``, ``b``).

    The edges are dealt out to tasks of some ``EDGES``, and each makes stars of its own. If there is more than one task,
    rounds over the whole table join them. Nodes are longs; loops are ignored.
    """
    now = work.store(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = max(1, -(-now.count() // EDGES))
    stars = work.store(_contract(now, tasks).distinct() if tasks > 1 else _contract(now, tasks))
    work.drop(now)
    now = _rounds(stars, work, max_rounds) if tasks > 1 else stars
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
