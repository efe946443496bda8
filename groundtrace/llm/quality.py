"""Quality scores of texts from how well dictionaries of good and of bad text compress them.

One zstandard dictionary is trained on labelled good texts, one on bad ones. A text is compressed in pieces of
``PIECE`` bytes, each from its first byte to its last, once with either dictionary; the normalised difference of the
two sums of sizes, (bad - good) / (bad + good + ``STEADY``), is above 0 where the good dictionary serves better; the
constant keeps short texts near 0. A logistic curve over tanh(``BEND`` * difference), fitted on labelled texts that the
dictionaries have not seen, turns it into the probability of label 1.

The fit looks at no more than ``FIT_ROWS`` texts of each label, those whose keys have the smallest hashes, and at no
more than ``FIT_CHARS`` characters of each, from a place that a hash of the key picks. The class shares that the curve
is weighted by are counted over all labelled rows. Scoring reads every text whole.

Defined cases: a null text counts as empty; an empty text has difference 0 and so the score of the curve there. A key
with several rows gives the fit its text of smallest hash once, one with both labels none. Null keys and labels other
than 0 and 1 teach nothing. With only one label known every score is 1 or 0, as that label is; with none 0.5. Columns
of the tables beside those named may bear any name: they are carried in a struct.
"""

import pickle
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace.llm.tables import arrow_batches

FIT_ROWS = 1000
FIT_CHARS = 16384
PIECE = 512
DICTIONARY_BYTES = 1 << 16
LEVEL = 1
STEADY = 100  # bytes
BEND = 20


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve; ``constant`` is the score where there is nothing to compare with."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    offset: float = 0.0
    constant: float | None = None

    def score(self, difference: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(difference), self.constant)
        return 1 / (1 + np.exp(-(self.slope * np.tanh(BEND * difference) + self.offset)))


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    ready = zstandard.ZstdCompressionDict(dictionary)
    ready.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=ready, write_checksum=False, write_content_size=False,
                                    write_dict_id=False)


def compressed_size(text, dictionary: bytes, piece: int = PIECE, level: int = LEVEL) -> int:
    """Bytes of the text's pieces, each compressed with the dictionary."""
    compress, view = _compressor(dictionary, level).compress, memoryview(text)
    return sum(len(compress(view[i:i + piece])) for i in range(0, len(view), piece))


def sizes(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Compressed sizes of every whole text with the good and the bad dictionary."""
    whole = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    return tuple(np.array([compressed_size(t, d) for t in whole], np.int64) for d in (model.good, model.bad))


def difference(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return (bad - good) / (bad + good + STEADY)


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train on."""
    pieces = [t[i:i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" " * 8 + b" ".join(texts)[:DICTIONARY_BYTES]


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton steps; a small ridge keeps separable data finite."""
    features, theta = np.stack([np.tanh(BEND * x), np.ones(len(x))], axis=1), np.zeros(2)
    ridge, weight = np.diag([1e-4, 1e-6]), weight / weight.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-features @ theta))
        gradient = features.T @ (weight * (p - y)) + ridge @ theta
        step = np.linalg.solve(features.T @ (features * (weight * p * (1 - p))[:, None]) + ridge, gradient)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        theta -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(theta[0]), float(theta[1])


def train(texts: list[bytes], labels: np.ndarray, totals: tuple[int, int]) -> Model:
    """Dictionaries from three of four texts, the curve from the others; all serve both ends where a label has few."""
    if len(set(labels.tolist())) < 2:
        return Model(constant=float(labels[0]) if len(labels) else 0.5)
    place = np.zeros(len(labels), np.int64)
    for label in (0, 1):
        place[labels == label] = np.arange((labels == label).sum())
    hold = place % 4 == 3
    if len(set(labels[hold].tolist())) < 2 or min((~hold & (labels == k)).sum() for k in (0, 1)) < 8:
        learn = hold = np.ones(len(labels), bool)
    else:
        learn = ~hold
    model = Model(*[_dictionary([t for t, k, take in zip(texts, labels, learn) if take and k == label]) for label in (1, 0)])
    used = [t for t, take in zip(texts, hold) if take]
    x = difference(*sizes(pa.array(used, pa.binary()), model))
    y = labels[hold]
    weight = np.array([totals[k] / max((y == k).sum(), 1) for k in y], float)
    return Model(model.good, model.bad, *_curve(x, y, weight))


def _hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.lit(seed))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        rows: int = FIT_ROWS, seed: int = 11) -> Model:
    """Train on ``rows`` keys of each label at most; texts of other keys are not moved.

    Keys alone are counted and ranked; the few chosen ones, a table of at most 2 * ``rows`` rows, then meet the texts.
    """
    arrow_batches(docs.sparkSession)
    there = docs.select(F.col(key).alias("k")).filter("k is not null").distinct()
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)").join(
        there, "k", "left_semi").groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other")
    known = known.select("k", "y", _hash("k", seed).alias("h"))
    counted = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = known.filter("y = 0").orderBy("h", "k").limit(rows).unionAll(
        known.filter("y = 1").orderBy("h", "k").limit(rows))
    length = F.length("text")
    start = F.when(length > FIT_CHARS, F.pmod(F.xxhash64("k", "text"), length - FIT_CHARS + 1)).otherwise(0) + 1
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        F.broadcast(chosen), "k").select("k", "y", "h", F.struct(F.xxhash64("text").alias("of"), F.substring(
            "text", start.cast("int"), F.lit(FIT_CHARS)).alias("part")).alias("t")).groupBy("k", "y", "h").agg(
        F.min("t").alias("t")).select("k", "y", "h", F.col("t.part").alias("text"))
    sampled = pa.schema([("y", pa.int32()), ("h", pa.int64()), ("k", pa.string()), ("text", pa.string())])
    totals = (counted.get(0, 0), counted.get(1, 0))

    def fitted(batches):
        parts = [pa.Table.from_batches([b]).cast(sampled) for b in batches]
        table = pa.concat_tables(parts or [sampled.empty_table()]).sort_by([("h", "ascending"), ("k", "ascending")])
        whole = table.column("text").cast(pa.binary()).to_pylist()
        model = train(whole, table.column("y").to_numpy(), totals)
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    one = texts.select("y", "h", F.col("k").cast("string").alias("k"), "text").repartition(1)
    row = one.mapInArrow(fitted, "model binary").first()
    return pickle.loads(row["model"]) if row else Model(constant=0.5)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc, quality): the row as a struct, so that no name clashes, and score, difference and compressed sizes."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf("struct<score: double, difference: double, good_bytes: long, bad_bytes: long>")
    def measure(texts: pa.Array) -> pa.Array:
        good, bad = sizes(texts, model) if model.constant is None else (np.zeros(len(texts), np.int64),) * 2
        apart = difference(good, bad)
        return pa.StructArray.from_arrays([pa.array(model.score(apart)), pa.array(apart), pa.array(good), pa.array(bad)],
                                          ["score", "difference", "good_bytes", "bad_bytes"])

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       measure(F.coalesce(F.col(text), F.lit(""))).alias("quality"))
