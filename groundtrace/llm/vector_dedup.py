"""Near-deduplication of vectors with small-world graphs per shard.

Equal vectors collapse to one. The rest is dealt to shards by hash; each shard becomes one hierarchical
navigable small-world graph. Every vector queries every shard. In each batch of queries some are audited against
a scan of the shard: while the graph finds less than ``RECALL`` of their links to other vectors, the beam of the
task is widened and the batch asked again, up to the whole shard. Queries in dense regions ask the whole shard. Every link is confirmed by its cosine in double precision.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing.
Vectors of different length do not link. Rows that repeat a vec_id are separate vectors. A row without a vec_id
takes part; its component is the smallest vec_id reachable, if any. A shard holds at most ``SHARD_ROWS``
vectors on average. An empty table gives an empty result. Extra columns are ignored.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace.llm.components import components
from groundtrace.llm.small_world import DEGREE, Graph
from groundtrace.llm.tables import Work, arrow_batches

COSINE = 0.9
SHARDS = 8  # at least; more where a shard would exceed SHARD_ROWS
SHARD_ROWS = 1 << 16
TASK_QUERIES = 1 << 14, 1 << 16  # queries of one copy of a graph: at least, unless cores stay idle, and at most
PIECE = 1 << 18  # bytes of a graph that one row carries
BEAM = 16
AUDIT = 24  # audited queries of a batch
RECALL = 0.99
BATCH = 1024
_SLACK = 1e-4  # of single precision
_PAIRS = 1 << 16  # pairs whose cosine is taken at once


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _audited(graph: Graph, queries: np.ndarray, own: np.ndarray, width: int, least: float):
    """Pairs found for a batch, with the beam at which its audit passed. ``own`` is each query's own place among the
    members, or -1: its match with itself counts neither as link nor as found."""
    audit = np.arange(0, len(queries), max(1, len(queries) // AUDIT))
    sims = queries[audit].astype(np.float32) @ graph.vectors.T
    here = np.flatnonzero(own[audit] >= 0)
    sims[here, own[audit][here]] = -np.inf
    truth = (sims >= least).sum()
    while True:
        q, m = graph.within(queries, least, width)
        other = m != own[q]
        q, m = q[other], m[other]
        if width >= graph.sizes[0] or np.isin(q, audit).sum() >= RECALL * truth:
            return q, m, width
        width *= 2


def _build(members: DataFrame, work: Work) -> DataFrame:
    """(shard, piece, graph): the pickled ids, unit vectors and graph of each shard, built once and cut into pieces."""
    def run(batches):
        shard, ids, rows = None, [], []

        def made():
            x = unit(rows)
            hashed = (np.array(ids, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
            level = (-np.log((hashed.astype(np.float64) + 1) * 2.0 ** -53) / np.log(DEGREE)).astype(np.int64)
            order = np.argsort(-level, kind="stable")
            graph = Graph(x[order], level[order])
            data = pickle.dumps((np.array(ids)[order], x[order], graph.sizes, graph.links))
            for piece, at in enumerate(range(0, len(data), PIECE)):
                yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([piece], pa.int64()), pa.array([data[at:at + PIECE]], pa.binary())],
                                      names=["shard", "piece", "graph"])

        for batch in batches:
            for home, cid, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if home != shard:
                    if rows:
                        yield from made()
                    shard, ids, rows = home, [], []
                ids.append(cid)
                rows.append(vector)
        if rows:
            yield from made()

    dealt = members.repartition("shard").sortWithinPartitions("shard", "cid").select("shard", "cid", "vector")
    return work.store(dealt.mapInArrow(run, "shard long, piece long, graph binary"))


def _search(dealt: DataFrame, cosine: float) -> DataFrame:
    """(a, b) of the links between the queries and the members of each shard; the pieces of the graph come before its queries."""
    def run(batches):
        group, held, pieces, width, waiting, asked = None, None, [], BEAM, [], []

        def answer():
            nonlocal held, pieces, width
            if pieces and waiting:
                names, vectors, sizes, links = pickle.loads(b"".join(pieces))
                held, pieces = (names, vectors, Graph.of(vectors, sizes, links), np.argsort(names)), []
            if held is None or not waiting:
                return None
            members, vectors, graph, order = held
            x, names = unit(waiting), np.array(asked)
            near = order[np.minimum(np.searchsorted(members, names, sorter=order), len(members) - 1)]
            own = np.where(members[near] == names, near, -1)
            q, m, width = _audited(graph, x, own, width, cosine - _SLACK)
            a, b = names[q], members[m]
            use = np.concatenate([np.einsum("ed,ed->e", x[q[i:i + _PAIRS]], vectors[m[i:i + _PAIRS]]) >= cosine
                                  for i in range(0, len(q), _PAIRS)] or [np.zeros(0, bool)])
            return pa.record_batch([pa.array(np.maximum(a, b)[use]), pa.array(np.minimum(a, b)[use])], names=["a", "b"])

        for batch in batches:
            for shard, copy, cid, vector, graph in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, copy) != group or len(waiting) == BATCH:
                    if (found := answer()) is not None:
                        yield found
                    waiting, asked = [], []
                if (shard, copy) != group:
                    group, held, pieces, width = (shard, copy), None, [], BEAM
                if graph is not None:
                    pieces.append(graph)
                else:
                    waiting.append(vector)
                    asked.append(cid)
        if (found := answer()) is not None:
            yield found

    return dealt.select("shard", "copy", "cid", "vector", "graph").mapInArrow(run, "a long, b long")


def _links(classes: DataFrame, work: Work, cosine: float) -> DataFrame:
    """Distinct links (a, b) with a > b between classes (cid, vector), each dimension for itself."""
    total = classes.count()
    shards = max(SHARDS, -(-total // SHARD_ROWS))
    few, many = TASK_QUERIES
    idle = -(-3 * classes.sparkSession.sparkContext.defaultParallelism // shards)
    copies = max(1, -(-total // many), min(-(-total // few), idle))
    vector = classes.withColumn("dim", F.size("vector"))
    home = (F.pmod(F.xxhash64("cid"), F.lit(shards)) * 65536 + F.col("dim") % 65536).cast("long")
    graphs = _build(vector.select(home.alias("shard"), "cid", "vector"), work)
    empty = F.lit(None)
    held = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(False).alias("query"),
                         F.col("piece").alias("cid"), empty.cast("array<double>").alias("vector"), "graph")
    queries = vector.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        (F.col("s") * 65536 + F.col("dim") % 65536).cast("long").alias("shard"),
        F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(copies)).cast("int").alias("copy"), F.lit(True).alias("query"), "cid", "vector",
        empty.cast("binary").alias("graph"))
    dealt = held.unionByName(queries).repartition(shards * copies, "shard", "copy").sortWithinPartitions(
        "shard", "copy", "query", "cid")
    return work.store(_search(dealt, cosine).distinct())


def near_vectors(vectors: DataFrame, work: Work, cosine: float = COSINE, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component, kept."""
    arrow_batches(vectors.sparkSession)
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    usable = F.coalesce(~bad & some, F.lit(False))
    rows = work.store(vectors.select(
        F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vector"), usable.alias("usable"),
        F.xxhash64(F.lit(1), v).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2")))
    classes = work.store(rows.filter("usable").groupBy("h1", "h2").agg(
        F.first("vector").alias("vector"), F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")).withColumn(
        "cid", F.monotonically_increasing_id()))
    links = _links(classes.select("cid", "vector"), work, cosine)
    size = classes.select(F.col("cid").alias("n"), "copies")
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(size, F.col("b") == F.col("n")).groupBy("a").agg(F.sum("copies").alias("linked"))
    found = work.store(components(links, work))
    named = classes.join(found, F.col("cid") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id")).withColumnRenamed("component", "c")
    done = named.join(least, F.col("component") == F.col("c")).join(degree, F.col("cid") == F.col("a"), "left").select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"), "component_id",
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    joined = rows.filter("usable").drop("vector").join(
        done, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select("id", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(
        "id", "n_links", F.col("component_id").alias("component"),
        F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull() & F.col("component_id").isNull()).alias("kept"))
