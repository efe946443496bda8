"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi search.

The automaton reads a text once; at every position its output links give all pieces that end there, and
each relaxes the best score of that position. The best path is the segmentation of greatest total
piece score (the unigram reading of the vocabulary). Characters without a piece cost the unknown score and
fall back to byte pieces.

A piece holds the space mark only at its front, and some characters occur in no longer piece, so the best
path of a text is the best paths of its chunks in a row; repeated chunks are looked up. A vocabulary with
pieces across such borders is read without chunks.

Defined cases: null and empty texts give no ids. Texts are read whole, one at a time. A text that holds
the space mark itself decodes to spaces, as the format has it. Ids outside the vocabulary raise on
decoding. An empty table gives an empty result; repeated rows are encoded alike; extra columns pass through.
"""

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace.llm.tables import arrow_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # fixed values of the model format
UNKNOWN_PENALTY = 10.0  # fixed value: below the smallest score
CACHE = 400_000  # chunks a worker remembers
DECODE = 1 << 20  # ids decoded at once


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            value = data[at:at + n]
            at += n
        yield tag >> 3, value


class Vocabulary:
    """Pieces, scores and kinds of a model file; built from its bytes, so it travels to the executors."""

    def __init__(self, model: bytes):
        self.model = model
        self.pieces, self.scores, self.kinds = [], [], []
        self.prefix, extra, charsmap = True, True, b""
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 3:
                spec = dict(_fields(value))
                charsmap, self.prefix, extra = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap or extra:
            raise ValueError("only models with identity normalisation are supported")

    @classmethod
    def read(cls, path: str = MODEL) -> "Vocabulary":
        with open(path, "rb") as file:
            return cls(file.read())

    def __reduce__(self):
        return _vocabulary, (self.model,)


_BUILT: dict[bytes, "Vocabulary"] = {}
_CODERS: dict[int, "Coder"] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    if model not in _BUILT:
        _BUILT.clear()
        _BUILT[model] = Vocabulary(model)
    return _BUILT[model]


class Coder:
    """Encoder and decoder of one process."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        self.single, joined, crossing = set(), set(), False
        normal = [(i, p, s) for i, (p, s, k) in enumerate(zip(
            vocabulary.pieces, vocabulary.scores, vocabulary.kinds)) if k in (NORMAL, USER) and p]
        for i, piece, score in normal:
            self.automaton.add_word(piece, (len(piece), score, i))
            if len(piece) == 1:
                self.single.add(piece)
            else:
                joined.update(piece)
                crossing |= MARK in piece.lstrip(MARK)
        self.automaton.make_automaton()
        joined.discard(MARK)
        self.unknown_score = min((s for _, _, s in normal), default=0.0) - UNKNOWN_PENALTY
        inside = "".join(re.escape(c) for c in sorted(joined))
        self.chunks = None if crossing or not inside else re.compile(
            f"{MARK}*[{inside}]+|{MARK}+|.", re.DOTALL)
        kinds, pieces = vocabulary.kinds, vocabulary.pieces
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        self.output = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode()
                       if k in (NORMAL, USER) else " ⁇ ".encode() if k == UNKNOWN else b""
                       for p, k in zip(pieces, kinds)]
        self.size = np.array([len(x) for x in self.output], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.output), np.uint8)
        self.cache: dict[str, tuple] = {}

    def best(self, text: str) -> tuple:
        """Ids of the best path, in one pass over the text."""
        n = len(text)
        score, back = [0.0] + [-float("inf")] * n, [None] * (n + 1)
        single, unknown = self.single, self.unknown_score
        at = 0  # positions up to here are final
        if not len(self.automaton):
            matches = ()
        else:
            matches = self.automaton.iter(text)
        for end, (length, value, piece) in matches:
            while at < end:
                at += 1
                if text[at - 1] not in single and score[at - 1] + unknown > score[at]:
                    score[at], back[at] = score[at - 1] + unknown, (1, -1)
            start = end + 1 - length
            total = score[start] + value
            if total > score[end + 1]:
                score[end + 1], back[end + 1] = total, (length, piece)
        while at < n:
            at += 1
            if text[at - 1] not in single and score[at - 1] + unknown > score[at]:
                score[at], back[at] = score[at - 1] + unknown, (1, -1)
        out, at = [], n
        while at:
            length, piece = back[at]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(text[at - 1].encode()))
            else:
                out.append(self.unknown)
            at -= length
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.vocabulary.prefix:
            text = MARK + text
        if self.chunks is None:
            return list(self.best(text))
        cache, out = self.cache, []
        for chunk in self.chunks.findall(text):
            ids = cache.get(chunk)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = self.best(chunk)
                if len(chunk) <= 64:
                    cache[chunk] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        if len(ids) and ids.min() < 0:
            raise IndexError("negative id")
        parts = [self._bytes(ids[at:at + DECODE]) for at in range(0, len(ids), DECODE)]
        text = parts[0] if len(parts) == 1 else b"".join(parts)
        if self.vocabulary.prefix and text.startswith(b" "):
            text = text[1:]
        return text.decode("utf-8", "replace")

    def _bytes(self, ids: np.ndarray) -> bytes:
        """The outputs of the ids one after the other, gathered byte by byte from all outputs laid end to end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.begin[ids] - ends + size, size)
        return self.flat[np.arange(len(shift)) + shift].tobytes()


def coder(vocabulary: Vocabulary) -> Coder:
    if id(vocabulary) not in _CODERS:
        _CODERS.clear()
        _CODERS[id(vocabulary)] = Coder(vocabulary)
    return _CODERS[id(vocabulary)]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as array<int>."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a model file, of fixed size

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        one, offsets, values = coder(shared.value), [0], []
        for text in texts:
            ids = np.array(one.encode(text.as_py()), np.int32)
            values.append(ids)
            offsets.append(offsets[-1] + len(ids))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                        pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))

    return docs.withColumn(out, run(F.col(text_col)))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row of ids; null ids give null."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        one = coder(shared.value)
        return pa.array([None if not r.is_valid else one.decode(r.values.to_numpy()) for r in rows], pa.string())

    return docs.withColumn(out, run(F.col(ids_col)))
