"""Scan of commands for a table of indicators that fits every task: one pass over the texts, no shuffle.

Runs of up to eight bytes are read as numbers, one from each byte of a batch of texts. How often each run of an indicator
occurs in all texts is counted first; an indicator is then looked up by its rarest run, its anchor, and not at all if
that occurs nowhere. The places of anchors are compared with the whole indicator. UTF-8 needs no characters for this: the bytes
of one text occur in another only where its characters do.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 8         # bytes of an anchor; shorter indicators are looked up whole
BLOCK = 1 << 20   # places that are looked at together
SMALL = 4 << 20   # bytes of rules and indicators that every task can hold
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _numbers(padded: np.ndarray, start: int, count: int, width: int) -> np.ndarray:
    """The ``width`` bytes from each of ``count`` places as a number, the first byte highest."""
    eight = np.ndarray((count,), ">u8", padded, start, (1,)).astype(np.uint64)
    return eight >> np.uint64(8 * (WIDTH - width))


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(WIDTH, np.uint8)])


def _runs(indicator: bytes) -> tuple[int, np.ndarray]:
    """(width, the number of the run from each place of an indicator that is not empty)."""
    width = min(len(indicator), WIDTH)
    return width, _numbers(_padded(np.frombuffer(indicator, np.uint8)), 0, len(indicator) - width + 1, width)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, padded; where each begins and the last ends)."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return _padded(data), ends - ends[0]


class _Lookup:
    """Places of known numbers of one width: a table of bits excludes most, a search in order decides."""

    def __init__(self, known: np.ndarray, width: int):
        self.known, self.width = known, width  # in order, each once
        bits = min(max(16, len(known).bit_length() + 4), 26)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(known * _SPREAD) >> self.shift] = True

    def places(self, padded: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, which number is there) block by block."""
        size = len(padded) - WIDTH
        for start in range(0, size, BLOCK):
            numbers = _numbers(padded, start, min(BLOCK, size - start), self.width)
            at = np.flatnonzero(self.table[(numbers * _SPREAD) >> self.shift])
            which = np.minimum(np.searchsorted(self.known, numbers[at]), len(self.known) - 1)
            true = self.known[which] == numbers[at]
            yield at[true] + start, which[true]


def _run_counts(texts: DataFrame, known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each known number of each width occurs in all texts; a task sends one row per number that it met."""
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        lookups = [_Lookup(numbers, width) for width, numbers in sent.value.items()]
        met = [np.zeros(len(x.known), np.int64) for x in lookups]
        for batch in batches:
            padded, _ = _texts(batch.column(0))
            for lookup, n in zip(lookups, met):
                for _, which in lookup.places(padded):
                    n += np.bincount(which, minlength=len(n))
        for lookup, n in zip(lookups, met):
            seen = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(seen), lookup.width), pa.int32()), pa.array(seen), pa.array(n[seen])],
                                  names=["width", "which", "n"])

    counted = texts.mapInArrow(count, "width int, which long, n long").groupBy("width", "which").agg(F.sum("n").alias("n")).toArrow()
    counts = {width: np.zeros(len(numbers), np.int64) for width, numbers in known.items()}
    widths, which, n = (counted.column(i).to_numpy() for i in range(3))
    for width, found in counts.items():
        found[which[widths == width]] = n[widths == width]
    return counts


def _anchors(texts: DataFrame, indicators: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per width: (numbers in order, indicators and the places of their anchor), one row per indicator that may occur."""
    runs = [_runs(x) for x in indicators]
    known = {width: np.unique(np.concatenate([r for w, r in runs if w == width])) for width in {w for w, _ in runs}}
    counts = _run_counts(texts, known) if known else {}
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for i, (width, numbers) in enumerate(runs):
        n = counts[width][np.searchsorted(known[width], numbers)]
        place = int(n.argmin())
        if n[place]:
            chosen.setdefault(width, []).append((int(numbers[place]), i, place))
    found = {}
    for width, rows in chosen.items():
        rows.sort()
        found[width] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return found


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 ... ``count`` numbers for each."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(count.sum())


def _found(padded: np.ndarray, ends: np.ndarray, anchors, lookups, indicators: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, indicator) of a batch, each pair once."""
    raw, lengths = padded.tobytes(), np.array([len(x) for x in indicators])
    pairs = [np.zeros(0, np.int64)]
    for width, (numbers, who, place) in anchors.items():
        lookup = lookups[width]
        first = np.searchsorted(numbers, lookup.known)
        count = np.searchsorted(numbers, lookup.known, "right") - first
        for at, which in lookup.places(padded):
            row = _spread(first[which], count[which])
            start, of = np.repeat(at, count[which]) - place[row], who[row]
            text = np.searchsorted(ends, start, "right") - 1
            inside = (start >= 0) & (start + lengths[of] <= ends[np.clip(text, 0, len(ends) - 2) + 1])
            start, of, text = start[inside], of[inside], text[inside]
            if width == WIDTH:
                same = [raw[s:s + len(indicators[i])] == indicators[i] for s, i in zip(start.tolist(), of.tolist())]
                of, text = of[np.array(same, bool)], text[np.array(same, bool)]
            pairs.append(np.unique(text * len(indicators) + of))
    both = np.unique(np.concatenate(pairs))
    return both // max(len(indicators), 1), both % max(len(indicators), 1)


def scanned_hits(staged: DataFrame, known: list[tuple[str, str]], keep: tuple[str, ...]) -> DataFrame:
    """(keep..., rule, indicator) from rows with a lower-cased command ``_lc`` and different (rule, indicator) pairs."""
    everywhere = [(r, "") for r, w in known if not w]
    texts = list(dict.fromkeys(w for _, w in known if w))
    indicators = [w.encode() for w in texts]
    rules_of: dict[str, list[str]] = {w: [] for w in texts}
    for rule, indicator in known:
        if indicator:
            rules_of[indicator].append(rule)
    sent = staged.sparkSession.sparkContext.broadcast((indicators, _anchors(staged.select("_lc"), indicators)))
    rules = [r for w in texts for r in rules_of[w]] + [r for r, _ in everywhere]
    named = [w for w in texts for _ in rules_of[w]] + [w for _, w in everywhere]
    count = np.array([len(rules_of[w]) for w in texts], np.int64)
    first, always = np.cumsum(count) - count, np.arange(count.sum(), len(rules))
    names = staged.sparkSession.sparkContext.broadcast((rules, named))

    def scan(batches):
        indicators, anchors = sent.value
        lookups = {width: _Lookup(np.unique(rows[0]), width) for width, rows in anchors.items()}
        rule, indicator = (pa.array(x, pa.string()) for x in names.value)
        for batch in batches:
            padded, ends = _texts(batch.column(batch.num_columns - 1))
            text, of = _found(padded, ends, anchors, lookups, indicators)
            row = np.concatenate([_spread(first[of], count[of]), np.tile(always, batch.num_rows)])
            text = np.concatenate([np.repeat(text, count[of]), np.repeat(np.arange(batch.num_rows), len(always))])
            if len(row):
                kept = [batch.column(i).take(pa.array(text)) for i in range(batch.num_columns - 1)]
                yield pa.record_batch([*kept, rule.take(pa.array(row)), indicator.take(pa.array(row))], names=[*keep, "rule", "indicator"])

    rows = staged.select(*keep, "_lc")
    shape = T.StructType([*rows.schema.fields[:-1], T.StructField("rule", T.StringType()), T.StructField("indicator", T.StringType())])
    return rows.mapInArrow(scan, shape)
