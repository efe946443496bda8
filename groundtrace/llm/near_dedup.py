"""MinHash near-deduplication with an LSH forest.

A document is the set of its distinct ``SHINGLE``-word shingles. Documents of equal sets form a class and
only its smallest id goes on. ``TREES`` orders sort the classes by a signature of ``DEPTH`` min-hashes each.
Classes that share the first ``BASE`` values of an order form a region. In a region of at most ``REGION``
classes all are candidates of each other. Larger ones are sorted by their signatures, and each class first is a
candidate of its ``REACH`` neighbours, those of the longest common prefix. What this leaves apart is compared in a second
turn, region by region, at the smallest depth at which the pairs between different components are few. Members of
regions that are put off to a greater depth get further orders, read at the last depth alone, as many as
``last_orders`` takes from the threshold: a pair at the threshold is then missed there no more often than in small regions.

Two classes that meet are held against each other by sketches first. One holds the parities of the shingles in
64 * ``_ODD`` cells: two sketches never differ in more cells than the sets in shingles, so what it excludes is no link.
The other holds two bits of each min-hash; a pair at the threshold differs in more than ``most_apart`` of them with
probability ``MISS``. Only pairs that pass both are candidates. Candidates are confirmed on the full sets (64-bit hashes of every shingle): first the most frequent candidate of
each class, then all that still lie in different components. With 20 orders and a base of 4, a pair at the
threshold 0.85 shares no region with probability 4e-7, one at 0.8 with 2.6e-5; with 47 and 58 orders at the last
depth the same holds for what is put off.

Defined cases: null texts and texts without words have no set and stay alone. Rows of one doc_id are one
document of the graph: they share a component, each row has its own n_shingles. Rows without a doc_id stay
alone, component null, kept. Texts are read whole, in pieces. Ties go to the smaller id. An empty table gives
an empty result. Extra columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace.llm.components import components
from groundtrace.llm.tables import Work, arrow_batches, free_name
from groundtrace.llm.words import mix, sequence_hash, words

SHINGLE = 5
PERCENT = 80  # smallest similarity of a link, in hundredths
TREES = 20
BASE, DEPTH = 4, 8
REGION = 32
REACH = 3  # neighbours in a sorted order
MISS = 1e-7  # probability that the sketches of a pair at the threshold differ too much
_PART = TREES * DEPTH // 32  # 64-bit parts of the min-hash sketch
_ODD = 8  # and of the parity sketch
_SKETCH = _PART + _ODD
_CHUNK = 1024
_U = np.uint64


def shingle_sets(texts: pa.Array, k: int):
    """For each text, its distinct shingle hashes in ascending order."""
    w = words(texts, lower=True)
    grams = sequence_hash(w.hash, k, k)
    for d in range(len(texts)):
        at, to = int(w.first[d]), int(w.first[d + 1])
        if to - at >= k:
            yield np.unique(grams[at:to - k + 1])
        elif to > at:  # fewer words: the whole sequence is the one shingle
            yield sequence_hash(w.hash[at:to], to - at, 1000 + to - at)
        else:
            yield np.zeros(0, _U)


def last_orders(percent: int) -> int:
    """Orders besides TREES with which sharing no last prefix is as rare as sharing no region, at the threshold."""
    s = percent / 100
    if not 0 < s < 1:
        return 0
    return max(0, math.ceil(TREES * math.log1p(-s ** BASE) / math.log1p(-s ** DEPTH)) - TREES)


def most_apart(percent: int) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most, but for one pair in 1 / MISS.

    A min-hash is equal with the similarity as probability; of an unequal one both bits are even chances.
    """
    other = 1 - min(max(percent, 0), 100) / 100
    spread = np.ones(1)
    for _ in range(TREES * DEPTH):
        spread = np.convolve(spread, [1 - other * 3 / 4, other / 2, other / 4])
    return int(np.argmax(np.cumsum(spread[::-1])[::-1] <= MISS)) - 1 if spread[-1] <= MISS else len(spread) - 1


def _hashers(before: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, 2 * trees * DEPTH + 1, dtype=_U) + _U(2 * before * DEPTH)
    seeds = mix(at * _U(0x9E3779B97F4A7C15))
    return seeds[:trees * DEPTH] | _U(1), seeds[trees * DEPTH:]


def signature(values: np.ndarray, before: int = 0, trees: int = TREES) -> np.ndarray:
    """trees * DEPTH min-hashes of a non-empty set, for the orders after the first ``before``."""
    factor, offset = _hashers(before, trees)
    least = np.full(len(factor), np.iinfo(_U).max, _U)
    for at in range(0, len(values), _CHUNK):
        part = values[at:at + _CHUNK, None] * factor[None, :] + offset[None, :]
        np.minimum(least, (part ^ (part >> _U(32))).min(axis=0), out=least)
    return (mix(least) >> _U(32)).astype(np.uint32)


def _keys(sig: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Per tree: a 64-bit key of the first BASE values, and the later values as prefix keys."""
    sig = sig.reshape(-1, DEPTH).astype(_U)
    key = mix(np.arange(before + 1, before + len(sig) + 1, dtype=_U))
    out = []
    for i in range(DEPTH):
        key = mix((key ^ sig[:, i]) * _U(0x9E3779B97F4A7C15) + _U(i))
        if i >= BASE - 1:
            out.append(key)
    return out[0].view(np.int64), np.stack(out[1:], axis=1).view(np.int64)


def sketch(sig: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Two bits of each of the first TREES * DEPTH min-hashes, then the parities of a set's values, in 64-bit parts."""
    two = (sig[:TREES * DEPTH].astype(_U) & _U(3)).reshape(_PART, 32)
    least = (two << (_U(2) * np.arange(32, dtype=_U))).sum(axis=1, dtype=_U).view(np.int64)
    cell = (mix(values ^ _U(0x2545F4914F6CDD1D)) % _U(64 * _ODD)).astype(np.int64)
    odd = np.packbits((np.bincount(cell, minlength=64 * _ODD) & 1).astype(np.uint8), bitorder="little").view(np.int64)
    return np.concatenate([least, odd])


def _apart(a: str, b: str, parts: range):
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in parts), F.lit(0))


def _alike(a: str, b: str, na: str, nb: str, percent: int):
    """Whether the sketches in columns a and b, of sets of na and nb shingles, are near enough."""
    odd = _apart(a, b, range(_PART, _SKETCH))
    return ((odd * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent))
            & (_apart(a, b, range(_PART)) <= most_apart(percent)))


def profiles(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), c1 and c2 (128-bit key of the set), keys and deeper (region keys by tree and depth), sketch."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, c1, c2, keys, deeper, sketches = [], [], [], [], [], []
            for values in shingle_sets(batch.column(1), shingle):
                n.append(len(values))
                c1.append(int(mix(values).sum(dtype=_U).view(np.int64)) if len(values) else 0)
                c2.append(int(mix(values ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)) if len(values) else 0)
                if len(values):
                    sig = signature(values)
                    base, more = _keys(sig)
                    sketches.append(sketch(sig, values))
                    keys.append(base)
                    deeper.append(more.ravel())
            full = np.array(n) > 0
            offsets = np.concatenate([[0], np.cumsum(full)]).astype(np.int32)

            def lists(parts, width):
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                return pa.ListArray.from_arrays(pa.array(offsets * np.int32(width)), pa.array(flat))

            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()),
                                   pa.array(c2, pa.int64()), lists(keys, TREES),
                                   lists(deeper, TREES * (DEPTH - BASE)), lists(sketches, _SKETCH)],
                                  names=["id", "n", "c1", "c2", "keys", "deeper", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n long, c1 long, c2 long, keys array<long>, deeper array<long>, sketch array<long>")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, c1, set) of the documents that take part in a candidate pair."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [v.view(np.int64) for v in shingle_sets(batch.column(1), shingle)]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(np.concatenate(parts)))], names=["id", "set"])

    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        ids, "id", "left_semi")
    return wanted.mapInArrow(run, "id long, set array<long>")


def _last_keys(sets: DataFrame, orders: int) -> DataFrame:
    """(p, id, n, sketch): the last prefix of every set in the orders after the first TREES, and their sketch."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets = batch.column(1).offsets.to_numpy()
            values = batch.column(1).values.to_numpy().view(_U)
            n = np.diff(offsets).astype(np.int64)
            parts = [values[at:to] for at, to in zip(offsets[:-1], offsets[1:])]
            sigs = [signature(part, TREES, max(orders, TREES)) for part in parts]
            keys = [_keys(sig[:orders * DEPTH], TREES)[1][:, -1] for sig in sigs]
            own = pa.array(np.repeat(np.arange(len(n)), orders))
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * np.int32(_SKETCH)),
                                                pa.array(np.concatenate([sketch(*both) for both in zip(sigs, parts)])))
            yield pa.record_batch([pa.array(np.concatenate(keys)), batch.column(0).take(own),
                                   pa.array(np.repeat(n, orders)), sketches.take(own)], names=["p", "id", "n", "sketch"])

    return sets.select("id", "set").mapInArrow(run, "p long, id long, n long, sketch array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("i")
    return both.filter(F.col("i") * 100 >= union * percent).select("a", "b")


def _unlinked(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components; nodes without a component are alone."""
    ca = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(ca, "a", "left").join(cb, "b", "left").filter(
        F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _near_sizes(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _neighbours(large: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the REACH classes before it in each sorted order, if in one region and alike.

    Rows are dealt by ranges of the order, so a hot region takes many tasks; pairs that a range cuts apart are left
    to the second turn.
    """
    limit = most_apart(percent)
    order = ["key", "deeper", "id"]
    dealt = large.select(*order, "n", "sketch").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(at).to_numpy() for at in range(3)]
                                   + [batch.column(3).flatten().to_numpy().reshape(-1, _SKETCH)])
            old = 0 if held is None else len(held)
            rows = rows if held is None else np.concatenate([held, rows])
            found = []
            for step in range(1, REACH + 1):
                x, y = rows[step:], rows[:-step]
                big, small = np.maximum(x[:, 2], y[:, 2]), np.minimum(x[:, 2], y[:, 2])
                bits = np.bitwise_count((x[:, 3:] ^ y[:, 3:]).view(_U)).astype(np.int64)
                apart, odd = bits[:, :_PART].sum(axis=1), bits[:, _PART:].sum(axis=1)
                good = ((x[:, 0] == y[:, 0]) & (x[:, 1] != y[:, 1]) & (small * 100 >= big * percent) & (apart <= limit)
                        & (odd * (100 + percent) <= (big + small) * (100 - percent)) & (np.arange(step, len(rows)) >= old))
                found.append(np.stack([x[good, 1], y[good, 1]]))
            pairs = np.concatenate(found, axis=1)
            held = rows[-REACH:]
            yield pa.record_batch([pa.array(pairs.max(axis=0)), pa.array(pairs.min(axis=0))], names=["a", "b"])

    return dealt.select("key", "id", "n", "sketch").mapInArrow(run, "a long, b long")


def _members(heads: DataFrame) -> DataFrame:
    """(key, id, n, deeper, sketch, m): the classes of each region of m > 1. Wide columns are sent once a class, not once an order."""
    width = DEPTH - BASE
    own = ["id", "n", "c1", "c2"]
    regions = heads.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    places = heads.select(*own, F.posexplode("keys").alias("t", "key")).join(regions, "key").groupBy(*own).agg(
        F.collect_list(F.struct("t", "key", "m")).alias("places"))
    return heads.select(*own, "deeper", "sketch").join(places, own).select(
        "id", "n", F.explode("places").alias("at"), "deeper", "sketch").select(
        "at.key", "id", "n", F.slice("deeper", F.col("at.t") * width + 1, F.lit(width)).alias("deeper"), "sketch", "at.m")


def _region_pairs(inside: DataFrame, percent: int) -> DataFrame:
    """Candidates of the first turn: (a, b, votes) with a > b."""
    small = inside.filter(F.col("m") <= REGION)
    left = small.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = small.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    pairs = left.join(right, "key").filter((F.col("a") > F.col("b")) & _near_sizes("na", "nb", percent)
                                           & _alike("sa", "sb", "na", "nb", percent)).select("a", "b")
    beside = _neighbours(inside.filter(F.col("m") > REGION), percent)
    return pairs.unionByName(beside).groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))


def _split_regions(level: DataFrame) -> DataFrame:
    """Members of the regions ``p`` that lie in several components, with the largest of these and the rows outside it."""
    parts = level.groupBy("p", "c").agg(F.count(F.lit(1)).alias("k"))
    regions = parts.groupBy("p").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("m"),
                                     F.count(F.lit(1)).alias("parts")).filter("parts > 1").select(
        F.col("p").alias("q"), F.col("top.c").alias("main"), "m", (F.col("m") - F.col("top.k")).alias("few"))
    return level.join(regions, F.col("p") == F.col("q")).drop("q")


def _across(here: DataFrame, percent: int) -> DataFrame:
    """The pairs of a region between different components that are alike."""
    few = here.filter("c <> main").select("p", F.col("id").alias("x"), F.col("n").alias("nx"),
                                          F.col("c").alias("cx"), F.col("sketch").alias("sx"))
    return few.join(here.select("p", "id", "n", "c", "main", "sketch"), "p").filter(
        ((F.col("c") == F.col("main")) | (F.col("c") < F.col("cx"))) & (F.col("c") != F.col("cx"))
        & _near_sizes("nx", "n", percent) & _alike("sx", "sketch", "nx", "n", percent)).select(
        F.greatest("x", "id").alias("a"), F.least("x", "id").alias("b")).distinct()


def _left_over(inside: DataFrame, found: DataFrame, sets: DataFrame, work: Work, percent: int) -> DataFrame:
    """Candidates of the second turn: pairs of a large region in different components.

    A region is compared at the smallest depth at which those who are not in its largest component, held
    against all, make at most REGION pairs for each class; at the last depth all that is left is compared.
    Whoever was in a region put off is also compared by the last prefixes of the further orders.
    """
    large = inside.filter(F.col("m") > REGION).select("key", "id", "n", "deeper", "sketch")
    own = found.select(F.col("node").alias("id"), "component")
    level = work.store(large.join(own, "id", "left").select(
        F.col("key").alias("p"), "id", "n", "deeper", "sketch", F.coalesce("component", "id").alias("c")))
    out = None
    for depth in range(BASE, DEPTH + 1):
        joined = work.store(_split_regions(level))
        now = F.lit(True) if depth == DEPTH else F.col("few") <= REGION
        pairs = _across(joined.filter(now), percent)
        out = pairs if out is None else out.unionByName(pairs)
        if depth == DEPTH:
            break
        rest = joined.filter(~now)
        if not rest.limit(1).count():
            break
        if depth == BASE and last_orders(percent):
            off = rest.select("id").distinct()
            keys = _last_keys(sets.join(off, "id", "left_semi"), last_orders(percent)).join(own, "id", "left").select(
                "p", "id", "n", "sketch", F.coalesce("component", "id").alias("c"))
            out = out.unionByName(_across(work.store(_split_regions(work.store(keys))), percent))
        level = rest.select(F.col("deeper")[depth - BASE].alias("p"), "id", "n", "deeper", "sketch", "c")
    return out.distinct()


def near_duplicates(docs: DataFrame, work: Work, shingle: int = SHINGLE, percent: int = PERCENT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component (smallest id reachable), kept (it is that id)."""
    rows = work.store(profiles(docs, shingle, id_col, text_col))
    named = rows.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    rep = work.store(named.groupBy("c1", "c2", "n").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    first = rep.select("rep", "n", F.col("c1").alias("r1"), F.col("c2").alias("r2"))
    heads = named.join(first.select("rep", "r1", "r2"), (F.col("id") == F.col("rep")) & (F.col("c1") == F.col("r1"))
                       & (F.col("c2") == F.col("r2"))).select("id", "n", "c1", "c2", "keys", "deeper", "sketch").dropDuplicates(
        ["id", "n", "c1", "c2"])  # one doc_id may head several sets, also of one size
    inside = work.store(_members(heads))
    pairs = work.store(_region_pairs(inside, percent))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(
        inside.filter(F.col("m") > REGION).select("id")).distinct()
    sets = work.store(_sets(docs, ids, shingle, id_col, text_col))
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("votes", -F.col("b"))).alias("b"))
    links = work.store(_confirm(best.select("a", "b"), sets, percent))
    found = work.store(components(links, work))
    more = work.store(_confirm(_unlinked(pairs.select("a", "b"), found), sets, percent))
    if more.limit(1).count():
        links = links.unionByName(more)
        found = work.store(components(links, work))
    if inside.filter(F.col("m") > REGION).limit(1).count():
        rest = work.store(_confirm(_left_over(inside, found, sets, work, percent), sets, percent))
        links = links.unionByName(rest)
        changed = rest.limit(1).count()
    else:
        changed = 0
    spread = named.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("id").alias("i"))
    same = named.join(spread, F.col("id") == F.col("i")).join(
        rep.select("c1", "c2", "rep"), ["c1", "c2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    if changed or same.limit(1).count():
        found = work.store(components(links.unionByName(same), work))
    head = rep.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("n").alias("kn"),
        F.coalesce("component", "rep").alias("found"), "copies")
    alone = rows.filter(F.col("id").isNull() | (F.col("n") == 0)).select(
        "id", "n", F.col("id").alias("component"))
    shared = named.join(head, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2"))
                        & (F.col("n") == F.col("kn"))).select("id", "n", F.col("found").alias("component"))
    return shared.unionByName(alone).select(
        "id", F.col("n").alias("n_shingles"), "component",
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_documents(docs: DataFrame, work: Work, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the documents that stay: one document of each component."""
    name = free_name(docs, "_gone")
    gone = near_duplicates(docs, work, id_col=id_col, text_col=text_col).filter(~F.col("kept")).select(
        F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
