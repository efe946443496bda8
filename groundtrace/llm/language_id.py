"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the byte n-grams of a lower-cased word with its borders, hashed to ``BUCKETS`` rows of a
small embedding. A text's score is the softmax of a linear map of the mean embedding; since mean and map
are linear, prediction sums one row of class scores per n-gram. Training is stochastic gradient descent
in numpy over at most ``FIT_ROWS`` different labelled texts per language and some ``FIT_TOTAL`` in all, those of smallest
hash, the only bounded sample: their counts are made in Spark tasks and one task trains on them. A fifth of the sample sets the temperature of the
scores and the levels below which a prediction is rejected: one of its score, one of its familiarity, the mean log
frequency of the text's n-grams in the predicted language. A softmax is sure of texts far from all it learned;
familiarity is not. Its level lies between held-back texts in their own language and the same texts in the best
of the other languages, which is how a language looks that was not learned.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected. Without any
label every text is ``und``; with one label it gets that label. Null labels teach nothing. Long texts are
read whole, in pieces. Repeated rows are predicted alike. Extra columns pass through. An empty table
gives an empty result.
"""

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtrace.llm.tables import arrow_batches
from groundtrace.llm.words import _SPACE, PIECE, buffers

BUCKETS = 1 << 15
DIMENSIONS = 16
ORDERS = (2, 3, 4)
FIT_ROWS = 400  # different labelled documents per language that training may look at
FIT_TOTAL = 2000  # of all languages together, at least MIN_ROWS of each
MIN_ROWS = 8
STEPS = 1800  # minibatches of training, whatever the size of the sample
UNKNOWN = "und"
SMOOTHING = 0.01  # of the n-gram frequencies of a language, in documents
SPREADS = 3.0  # standard errors by which a short text may fall below the level of familiarity
REJECT_QUANTILE = 0.001  # share of right calibration documents that rejection may cost


def _grams(part: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram that ends at each byte, one row per order; BUCKETS where there is none."""
    space = _SPACE[part]
    value = np.where(space, np.uint8(32), part).astype(np.uint32)
    out = np.full((len(ORDERS), len(part)), BUCKETS, np.int32)
    for row, n in enumerate(ORDERS):
        m = len(part) - n + 1
        if m <= 0:
            continue
        code = value[:m].copy()
        for i in range(1, n):
            code = (code << np.uint32(8)) | value[i:i + m]
        code = (code + np.uint32(n)) * np.uint32(2654435761)
        bucket = (code >> np.uint32(17)).astype(np.int32)
        inner = space[1:1 + m].copy() if n > 2 else space[:m] & space[1:1 + m]
        for i in range(2, n - 1):
            inner |= space[i:i + m]
        out[row, n - 1:] = np.where(inner, BUCKETS, bucket)
    return out


def _parts(texts: pa.Array):
    """(first text, offsets within the part, grams) of pieces; a long text comes in several."""
    data, offsets = buffers(texts)
    at, overlap = 0, max(ORDERS) - 1
    while at < len(data):
        to = min(len(data), at + PIECE)
        back = min(at, overlap)
        grams = _grams(data[at - back:to])[:, back:]
        first = int(np.searchsorted(offsets, at, "right")) - 1
        last = int(np.searchsorted(offsets, to, "left"))
        yield first, np.maximum(offsets[first:last], at) - at, grams
        at = to


def _counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    total = [({}) for _ in range(len(texts))]
    for first, starts, grams in _parts(texts):
        ends = np.append(starts[1:], grams.shape[1])
        for k, (s, e) in enumerate(zip(starts, ends)):
            values, n = np.unique(grams[:, s:e], return_counts=True)
            seen = total[first + k]
            for v, c in zip(values.tolist(), n.tolist()):
                if v < BUCKETS:
                    seen[v] = seen.get(v, 0) + c
    return total


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # (BUCKETS + 1, labels): class scores of each subword, zero for none
    bias: np.ndarray
    temperature: float
    reject_below: float
    familiar: np.ndarray | None = None  # (BUCKETS + 1, labels): log frequency of each subword, times BUCKETS
    unfamiliar_below: float = -np.inf
    spread: float = 0.0  # standard deviation of ``familiar`` over the subwords of a text

    def accepts(self, p: np.ndarray, familiarity: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which texts have a score and, in the predicted language, a mean familiarity high enough."""
        own = familiarity[np.arange(len(p)), p.argmax(axis=1)] + SPREADS * self.spread / np.sqrt(np.maximum(n, 1))
        return (p.max(axis=1) >= self.reject_below) & (own >= self.unfamiliar_below)

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of scores, sums of familiarity and number of subwords of each text."""
        table = self.scores if self.familiar is None else np.hstack([self.scores, self.familiar])
        sums, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
        for first, starts, grams in _parts(texts):
            last = first + len(starts)
            nonempty = np.append(starts[1:], grams.shape[1]) > starts
            for row in grams:
                part = np.add.reduceat(table[row], starts, axis=0)
                sums[first:last] += np.where(nonempty[:, None], part, 0)
                hits = np.add.reduceat((row < BUCKETS).astype(np.int32), starts)
                n[first:last] += np.where(nonempty, hits, 0)
        own = sums[:, len(self.labels):] if self.familiar is not None else np.zeros((len(texts), len(self.labels)))
        return sums[:, :len(self.labels)], own, n


def _train(idx, val, ptr, y, labels: int, seed: int):
    """Minibatch SGD; rows of the sparse matrix are n-gram frequencies of a document."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, labels), np.float32), np.zeros(labels, np.float32)
    n, batch = len(y), 16
    epochs = -(-STEPS // -(-n // batch))
    steps, step = epochs * -(-n // batch), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at:at + batch]
            rate = 1.0 - step / steps
            step += 1
            lengths = ptr[rows + 1] - ptr[rows]
            pick = np.concatenate([np.arange(ptr[r], ptr[r + 1]) for r in rows])
            columns, where = np.unique(idx[pick], return_inverse=True)
            x = np.zeros((len(rows), len(columns)), np.float32)
            x[np.repeat(np.arange(len(rows)), lengths), where] = val[pick]
            hidden = x @ emb[columns]
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            step_in = x.T @ (p @ out.T)
            out -= 4.0 * rate * (hidden.T @ p)
            bias -= 0.5 * rate * p.sum(axis=0)
            emb[columns] -= 40.0 * rate * step_in
    return emb @ out, bias


def _spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def _sample(labelled: DataFrame, rows: int, total: int, seed: int) -> DataFrame:
    """(label, h, text) of each label's different texts of smallest hash; only hashes are ranked."""
    hashed = labelled.withColumn("h", F.xxhash64("text", F.lit(seed)))
    keys = hashed.select("label", "h").distinct()
    labels = labelled.select("label").distinct().count()
    quota = min(rows, max(MIN_ROWS, total // max(1, labels)))
    ranked = keys.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h"))).filter(F.col("r") <= quota)
    last = ranked.groupBy(F.col("label").alias("of")).agg(F.max("h").alias("most"))
    return hashed.join(last, (F.col("label") == F.col("of")) & (F.col("h") <= F.col("most"))).groupBy("label", "h").agg(
        F.first("text").alias("text"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, total: int = FIT_TOTAL,
        seed: int = 5) -> Model:
    """Train on at most ``rows`` different texts of each language."""
    arrow_batches(docs.sparkSession)
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("label")).filter(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = _sample(labelled, rows, total, seed).select("label", "h", _spaced(F.col("text")).alias("text"))

    counted = pa.schema([("label", pa.string()), ("h", pa.int64()), ("idx", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def count(batches):
        for batch in batches:
            got = _counts(batch.column("text"))
            yield pa.record_batch(
                [batch.column("label"), batch.column("h"), pa.array([list(g) for g in got], pa.list_(pa.int32())),
                 pa.array([list(g.values()) for g in got], pa.list_(pa.int32()))],
                names=["label", "h", "idx", "n"])

    def train(batches):
        table = pa.Table.from_batches(list(batches), schema=counted)
        yield pa.record_batch([pa.array([pickle.dumps(_fit(table, seed))], pa.binary())], names=["model"])

    counts = sample.mapInArrow(count, "label string, h long, idx array<int>, n array<int>").repartition(1)
    row = counts.mapInArrow(train, "model binary").first()
    return pickle.loads(row["model"]) if row else Model([], np.zeros((BUCKETS + 1, 0)), np.zeros(0), 1.0, 0.0)


def _fit(found: pa.Table, seed: int) -> Model:
    """Train and calibrate on the counts of the sample, in one task: the sample is bounded."""
    label, h = found.column("label").to_pylist(), found.column("h").to_numpy()
    labels = sorted(set(label))
    if len(labels) < 2:
        return Model(labels, np.zeros((BUCKETS + 1, len(labels))), np.zeros(len(labels)), 1.0, 0.0)
    order = np.lexsort((h, np.array(label)))
    idx_all, n_all = found.column("idx").combine_chunks(), found.column("n").combine_chunks()
    idx = [np.asarray(idx_all[int(i)].values) for i in order]
    val = [np.asarray(n_all[int(i)].values).astype(np.float32) for i in order]
    for v in val:
        v /= max(v.sum(), 1)
    y = np.array([labels.index(label[i]) for i in order])
    hold = np.arange(len(y)) % 5 == 4
    if len(set(y[~hold])) < len(labels):
        hold[:] = False

    def matrix(rows):
        ptr = np.concatenate([[0], np.cumsum([len(idx[i]) for i in rows])]).astype(np.int64)
        return np.concatenate([idx[i] for i in rows]), np.concatenate([val[i] for i in rows]), ptr, y[rows]

    scores, bias = _train(*matrix(np.flatnonzero(~hold)), len(labels), seed)
    model = Model(labels, np.vstack([scores, np.zeros((1, len(labels)), np.float32)]), bias, 1.0, 0.0)
    test = np.flatnonzero(hold if hold.any() else ~hold)
    sums = np.array([val[i] @ scores[idx[i]] for i in test])
    best = None
    for temperature in np.geomspace(0.05, 4, 30):
        model.temperature = temperature
        p = model.probabilities(sums, np.ones(len(test)))
        loss = -np.log(np.maximum(p[np.arange(len(test)), y[test]], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, temperature, p)
    model.temperature, p = float(best[1]), best[2]
    right = p.max(axis=1)[p.argmax(axis=1) == y[test]]
    wrong = p.max(axis=1)[p.argmax(axis=1) != y[test]]
    level = float(np.quantile(right, REJECT_QUANTILE)) if len(right) else 0.0
    model.reject_below = min(level, float(wrong.max()) if len(wrong) else level * 0.5)
    seen = np.full((BUCKETS + 1, len(labels)), SMOOTHING)
    for i in np.flatnonzero(~hold):
        seen[idx[i], y[i]] += val[i]
    familiar = np.log(seen / seen[:-1].sum(axis=0) * BUCKETS)
    familiar[-1] = 0.0
    model.familiar = familiar.astype(np.float32)
    own = np.array([val[i] @ familiar[idx[i]] for i in test])
    right = own[np.arange(len(test)), y[test]]
    own[np.arange(len(test)), y[test]] = -np.inf
    least, most = np.quantile(right, REJECT_QUANTILE), np.quantile(own.max(axis=1), 1 - REJECT_QUANTILE)
    model.unfamiliar_below = float((least + most) / 2 if most < least else least)
    square = np.array([val[i] @ familiar[idx[i], y[i]] ** 2 for i in test])
    model.spread = float(np.sqrt(np.maximum(square - right ** 2, 0).mean()))
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``language``: struct of lang, score and accepted."""
    arrow_batches(docs.sparkSession)
    labels = np.array(model.labels, object)

    @F.arrow_udf("struct<lang: string, score: double, accepted: boolean>")
    def guess(texts: pa.Array) -> pa.Array:
        sums, familiarity, n = model.sums(texts)
        p = model.probabilities(sums, n)
        accepted = model.accepts(p, familiarity / np.maximum(n, 1)[:, None], n)
        lang = pa.array(labels[p.argmax(axis=1)], pa.string())
        return pa.StructArray.from_arrays([lang, pa.array(p.max(axis=1)), pa.array(accepted)], ["lang", "score", "accepted"])

    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    known = guess(_spaced(F.col(text_col))) if model.labels else unknown
    out = docs.withColumn("_guess", known)
    return out.withColumn("language", F.when(letters, F.col("_guess")).otherwise(unknown)).drop("_guess")


def keep_known(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is recognised; those rejected go."""
    model = fit(docs, text_col, lang_col)
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_d"), F.col(text_col).alias("_text"))
    return predict(own, model, "_text").filter("language.accepted").select("_d.*")
