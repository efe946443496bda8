"""Substring deduplication by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of a document. Every window has an anchor, the five words of
smallest hash inside it, so equal windows have equal anchors and about every fifth position of a text is an
anchor. Only windows whose anchor occurs in several documents are looked at further.

1. Confirm: windows (64 bits of their words, 31 of their anchor) that occur in several documents, with the
   smallest such document. A join of the windows with these names the shards that a text visits, no place in it.
2. Compile: the recurring windows of those first documents, dealt to shards by first document, become
   Aho-Corasick automata over word numbers.
3. Stream: texts run whole through the automata of the shards they visit, word by word, and every occurrence is
   located there. Texts of more than ``PIECE_WORDS`` words run in pieces that overlap by a window less one word.

A shard that very much text visits is dealt to several tasks, each with a copy of its automaton; one with very
many phrases is cut into several automata that all its texts visit. Documents of equal word sequences
collapse first: all but the smallest are removed as a whole.

Defined cases: null texts have no words; texts shorter than a window keep all words. Rows of one doc_id are one
document: they do not remove words of each other. A row without a doc_id keeps its words and removes none.
Repeated rows have equal results. Texts are read whole. An empty table gives an empty result. Extra columns
are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace.llm.tables import Work, arrow_batches
from groundtrace.llm.words import mix, sequence_hash, words

WINDOW = 13
ANCHOR = 5
SHARD_PHRASES = 20_000  # recurring windows of a shard on average, and the most of one automaton: twice that
TASK_BYTES = 32 << 20  # text that one copy of an automaton streams
PIECE_WORDS = 20_000  # longer texts are streamed in pieces of so many window positions
_BLOCK = 1 << 16
_BYTES = pa.binary()
_U = np.uint64


def _window_anchors(h: np.ndarray, first: np.ndarray, window: int):
    """In blocks of word positions: (starts of windows, their texts, places of their anchors, the anchors)."""
    span = window - ANCHOR + 1
    for a in range(0, len(h) - window + 1, _BLOCK):
        grams = sequence_hash(h[a:a + _BLOCK + window - 1], ANCHOR, 77)
        m = len(grams) - span + 1
        least, place = grams[:m].copy(), np.zeros(m, np.int64)
        for i in range(1, span):
            less = grams[i:i + m] < least
            least[less] = grams[i:i + m][less]
            place[less] = i
        start = np.arange(a, a + m)
        text = np.searchsorted(first, start, "right") - 1
        whole = start + window <= first[text + 1]
        yield start[whole], text[whole], (place + start)[whole], least[whole]


def _changes(place: np.ndarray) -> np.ndarray:
    """Where a window has another anchor than the one before it."""
    return np.r_[np.ones(min(1, len(place)), bool), place[1:] != place[:-1]]


def _distinct_anchors(h: np.ndarray, first: np.ndarray, window: int) -> pa.Array:
    """The different anchors of each text, as lists."""
    texts, grams = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for _, text, place, least in _window_anchors(h, first, window):
        new = _changes(place)
        texts.append(text[new])
        grams.append(least[new])
    text, gram = np.concatenate(texts), np.concatenate(grams)
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.r_[np.ones(min(1, len(text)), bool), (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])]
    text, gram = text[new], gram[new]
    offsets = np.searchsorted(text, np.arange(len(first))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(gram.view(np.int64)))


def _sequence_keys(h: np.ndarray, first: np.ndarray, seeds: tuple) -> list[np.ndarray]:
    """For each seed, a key of the whole word sequence of each text; 0 without words."""
    out = [np.zeros(len(first) - 1, _U) for _ in seeds]
    for a in range(0, len(h), _BLOCK):
        part = h[a:a + _BLOCK]
        word = np.arange(a, a + len(part))
        text = np.searchsorted(first, word, "right") - 1
        at = (word - first[text]).astype(_U)
        starts = np.flatnonzero(_changes(text))
        for total, seed in zip(out, seeds):
            total[text[starts]] += np.add.reduceat(mix(part ^ mix(at + _U(seed))), starts)
    return [total.view(np.int64) for total in out]


def _profile(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """id, words, s1, s2 (key of the word sequence), sha (of the words joined by spaces) and anchors."""
    def run(batches):
        for batch in batches:
            w = words(batch.column(1))
            s1, s2 = _sequence_keys(w.hash, w.first, (1, 8))
            sha = [hashlib.sha256(b" ".join((text or b"").split())).hexdigest()
                   for text in batch.column(1).cast(_BYTES).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(w.first)), pa.array(s1), pa.array(s2), pa.array(sha, pa.string()),
                 _distinct_anchors(w.hash, w.first, window)], names=["id", "words", "s1", "s2", "sha", "anchors"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, words long, s1 long, s2 long, sha string, anchors array<long>")


def _windows(candidates: DataFrame, window: int) -> DataFrame:
    """(w1, w2, id, s1, pos) of the windows whose anchor recurs: key of all words, some bits of the anchor."""
    def run(batches):
        for batch in batches:
            w = words(batch.column(2))
            ids, s1 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            known = np.unique(np.asarray(batch.column(3).flatten())).view(_U)
            for start, text, place, least in _window_anchors(w.hash, w.first, window):
                if not len(start):
                    continue
                new = _changes(place)
                use = np.flatnonzero(np.isin(least[new], known)[np.cumsum(new) - 1])
                if not len(use):
                    continue
                start, text = start[use], text[use]
                w1 = sequence_hash(w.hash[start[0]:start[-1] + window], window, 101)[start - start[0]].view(np.int64)
                yield pa.record_batch(
                    [pa.array(w1), pa.array((least[use] >> _U(33)).astype(np.int32)), pa.array(ids[text]), pa.array(s1[text]),
                     pa.array((start - w.first[text]).astype(np.int32))], names=["w1", "w2", "id", "s1", "pos"])

    return candidates.select("id", "s1", "text", "anchors").mapInArrow(
        run, "w1 long, w2 int, id long, s1 long, pos int")


def _pieces(candidates: DataFrame, window: int) -> DataFrame:
    """(id, s1, piece, text): texts cut every PIECE_WORDS words, with the words that a window reaches beyond."""
    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for own, s1, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = text.encode().split() if len(text) > 2 * PIECE_WORDS else []
                cuts = range(0, max(1, len(tokens) - window + 1), PIECE_WORDS)
                for at in cuts:
                    part = b" ".join(tokens[at:at + PIECE_WORDS + window - 1]).decode() if len(cuts) > 1 else text
                    for column, value in zip(out, (own, s1, at // PIECE_WORDS, part)):
                        column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                                   pa.array(out[3], pa.string())], names=["id", "s1", "piece", "text"])

    return candidates.select("id", "s1", "text").mapInArrow(run, "id long, s1 long, piece int, text string")


def _runs(pos: np.ndarray, window: int):
    """(first word, end) of the stretches that consecutive window positions cover."""
    cut = np.flatnonzero(np.diff(pos) > 1) + 1
    for part in np.split(pos, cut):
        yield int(part[0]), int(part[-1]) + window


def _streams(marked: DataFrame, window: int) -> DataFrame:
    """(home, phrases, id, s1, at, text): recurring stretches of first documents, from which the phrases of an
    automaton are made (phrases > 0, no home yet), and the whole pieces that visit the shard ``home``."""
    schema = "home long, phrases int, id long, s1 long, at int, text string"

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for own, s1, piece, text, places, homes in zip(*(c.to_pylist() for c in batch.columns)):
                base = piece * PIECE_WORDS
                rows = [(home, 0, own, s1, base, text) for home in homes]
                if places:
                    tokens = text.encode().split()
                    for at, end in _runs(np.unique(places) - base, window):
                        rows.append((None, end - at - window + 1, own, s1, base + at, b" ".join(tokens[at:end]).decode()))
                for row in rows:
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)],
                                  names=["home", "phrases", "id", "s1", "at", "text"])

    return marked.select("id", "s1", "piece", "text", "places", "homes").mapInArrow(run, schema)


def _pairs(line: np.ndarray) -> np.ndarray:
    return (line[:-1] << 32) | line[1:]


def _occurrences(automaton, line: np.ndarray, pairs: np.ndarray, window: int):
    """(last word, value) of each phrase in a text; where two words in a row are in no phrase, the automaton starts anew."""
    found = _pairs(line)
    known = pairs[np.minimum(np.searchsorted(pairs, found), len(pairs) - 1)] == found
    for begin, end in np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8))).reshape(-1, 2).tolist():
        if end - begin >= window - 1:
            for last, value in automaton.iter(tuple(line[begin:end + 1].tolist())):
                yield begin + last, value


def _locate(dealt: DataFrame, window: int) -> DataFrame:
    """(id, s1, at, end): the words covered by phrases of smaller documents."""
    def run(batches):
        import ahocorasick

        group, numbers, automaton, ready = None, {}, None, False
        for batch in batches:
            out = [[], [], [], []]
            texts = batch.column(6).cast(_BYTES).to_pylist()
            for (shard, copy, phrases, own, s1, at), text in zip(zip(*(c.to_pylist() for c in batch.columns[:6])), texts):
                if (shard, copy) != group:
                    group, numbers, ready = (shard, copy), {}, False
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
                    sources, pairs = [], []
                tokens = text.split()
                if phrases:
                    line = tuple([numbers.setdefault(t, len(numbers) + 1) for t in tokens])
                    sources.append(own)
                    pairs.append(_pairs(np.array(line)))
                    for i in range(phrases):
                        automaton.add_word(line[i:i + window], len(sources) - 1)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready, number = True, numbers.get
                    pairs = np.unique(np.concatenate(pairs)) if pairs else None
                if not len(automaton):
                    continue
                begin = end = -1
                line = np.array([number(t, 0) for t in tokens])
                for last, first in _occurrences(automaton, line, pairs, window):
                    if sources[first] < own:
                        if last - window + 1 > end and end >= 0:
                            for column, value in zip(out, (own, s1, at + begin, at + end)):
                                column.append(value)
                            end = -1
                        if end < 0:
                            begin = last - window + 1
                        end = last + 1
                if end >= 0:
                    for column, value in zip(out, (own, s1, at + begin, at + end)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "s1", "at", "end"])

    return dealt.select("shard", "copy", "phrases", "id", "s1", "at", "text").mapInArrow(
        run, "id long, s1 long, at int, end int")


def _deal(streams: DataFrame, shards: int, work: Work) -> DataFrame:
    """Give every row its shard and copy: phrases first in each, rows of a group in one task."""
    phrase = F.col("phrases") > 0
    named = streams.withColumn("home", F.coalesce("home", _home(F.col("id"), shards)))
    load = work.store(named.groupBy("home").agg(
        F.sum("phrases").alias("p"), F.sum(F.when(~phrase, F.octet_length("text"))).alias("b")).select(
        F.col("home").alias("h"), F.greatest(F.lit(1), F.ceil(F.col("p") / (2 * SHARD_PHRASES)).cast("int")).alias("cuts"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("b", F.lit(0)) / TASK_BYTES).cast("int")).alias("copies")))
    joined = named.join(load, F.col("home") == F.col("h"))
    row = F.xxhash64("id", "s1", "at")
    pick = F.transform(F.sequence(F.lit(0), F.when(phrase, F.col("copies")).otherwise(F.col("cuts")) - 1),
                       lambda i: F.when(phrase, F.struct(F.pmod(row, F.col("cuts")).cast("int").alias("cut"),
                                                         i.alias("copy"))).otherwise(
                           F.struct(i.alias("cut"), F.pmod(row, F.col("copies")).cast("int").alias("copy"))))
    return joined.withColumn("g", F.explode(pick)).select(
        F.col("g.copy").alias("copy"), "phrases", "id", "s1", "at", "text",
        (F.col("home") * 1_000_003 + F.col("g.cut")).alias("shard")).repartition("shard", "copy").sortWithinPartitions(
        "shard", "copy", F.col("phrases").desc())


def _home(source, shards: int):
    return F.pmod(F.xxhash64(source), F.lit(shards)).cast("long")


def _cut_words(texts: DataFrame) -> DataFrame:
    """(id, s1, n_removed, sha) of documents that lose words."""
    def run(batches):
        for batch in batches:
            out = []
            for d in range(batch.num_rows):
                tokens = np.array((batch.column(2)[d].as_py() or "").encode().split() + [b""], object)[:-1]
                gone = np.zeros(len(tokens), bool)
                for r in batch.column(3)[d].as_py():
                    gone[r["at"]:r["end"]] = True
                out.append((batch.column(0)[d].as_py(), batch.column(1)[d].as_py(), int(gone.sum()),
                            hashlib.sha256(b" ".join(tokens[~gone])).hexdigest()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("id", "s1", "n_removed", "sha"), r)) for r in out],
                schema=pa.schema([("id", pa.int64()), ("s1", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string())]))

    return texts.select("id", "s1", "text", "ranges").mapInArrow(
        run, "id long, s1 long, n_removed long, sha string")


def remove_repeats(docs: DataFrame, work: Work, window: int = WINDOW, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha (of the words that stay, joined by one space)."""
    arrow_batches(docs.sparkSession)
    profile = work.store(_profile(docs, window, id_col, text_col))
    rows = work.store(profile.drop("anchors"))
    classes = rows.filter(F.col("id").isNotNull() & (F.col("words") >= window)).groupBy("s1", "s2", "words").agg(
        F.min("id").alias("head"), F.max("id").alias("last"))
    copied = work.store(classes.filter("head < last"))
    named = profile.filter(F.col("id").isNotNull() & (F.col("words") >= window)).select("id", "s1", "s2", "anchors")
    heads = work.store(named.join(copied.select("s1", "s2", "head"), ["s1", "s2"], "left").filter(
        F.coalesce(F.col("id") == F.col("head"), F.lit(True))).select("id", "s1", "anchors"))
    work.drop(profile)
    each = heads.select("id", "s1", F.explode("anchors").alias("anchor"))
    recurring = work.store(each.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter(
        "low < high").select(F.col("anchor").alias("known")))
    wanted = work.store(each.join(recurring, F.col("anchor") == F.col("known")).groupBy("id", "s1").agg(
        F.collect_set("anchor").alias("anchors")))
    work.drop(heads, recurring)
    key = wanted.select(F.col("id").alias("i"), F.col("s1").alias("s"), "anchors")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if rows.groupBy("id").count().filter("count > 1 and id is not null").limit(1).count():
        texts = texts.join(key.select("i").distinct(), F.col("id") == F.col("i"), "left_semi")
        texts = _with_sequence(texts).join(key, (F.col("id") == F.col("i")) & (F.col("s1") == F.col("s"))).dropDuplicates(
            ["id", "s1"])
    else:
        texts = texts.join(key, F.col("id") == F.col("i")).withColumn("s1", F.col("s"))
    candidates = work.store(texts.select("id", "s1", "text", "anchors"))
    found = _windows(candidates, window)
    phrases = work.store(found.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter(
        "low < high").select(F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.col("low").alias("source")))
    shards = max(1, -(-phrases.count() // SHARD_PHRASES))
    first = F.col("id") == F.col("source")
    marks = work.store(found.join(phrases, (F.col("w1") == F.col("k1")) & (F.col("w2") == F.col("k2"))).groupBy(
        F.col("id").alias("i"), F.col("s1").alias("s"), F.floor(F.col("pos") / PIECE_WORDS).cast("int").alias("p")).agg(
        F.collect_list(F.when(first, F.col("pos"))).alias("places"),
        F.collect_set(F.when(~first, _home(F.col("source"), shards))).alias("homes")))
    work.drop(phrases)
    marked = _pieces(candidates, window).join(
        marks, (F.col("id") == F.col("i")) & (F.col("s1") == F.col("s")) & (F.col("piece") == F.col("p")))
    streams = work.store(_streams(marked, window))
    ranges = work.store(_locate(_deal(streams, shards, work), window).groupBy(
        F.col("id").alias("i"), F.col("s1").alias("s")).agg(F.collect_list(F.struct("at", "end")).alias("ranges")))
    work.drop(marks, streams)
    cut = work.store(_cut_words(candidates.join(ranges, (F.col("id") == F.col("i")) & (F.col("s1") == F.col("s")))))
    cut = cut.select(F.col("id").alias("i"), F.col("s1").alias("s"), F.col("n_removed").alias("r"), F.col("sha").alias("kept"))
    copied = copied.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("words").alias("cw"), "head")
    out = rows.join(copied, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("words") == F.col("cw")),
                    "left").join(cut, (F.col("id") == F.col("i")) & (F.col("s1") == F.col("s")), "left")
    copy = F.coalesce(F.col("id") > F.col("head"), F.lit(False))
    return out.select("id", F.col("words").alias("n_words"),
                      F.when(copy, F.col("words")).otherwise(F.coalesce("r", F.lit(0))).alias("n_removed"),
                      F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha"))


def _with_sequence(texts: DataFrame) -> DataFrame:
    """Texts with the key of their word sequence, to tell rows of one doc_id apart."""
    def run(batches):
        for batch in batches:
            w = words(batch.column(1))
            s1, = _sequence_keys(w.hash, w.first, (1,))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s1)], names=["id", "text", "s1"])

    return texts.select("id", "text").mapInArrow(run, "id long, text string, s1 long")
