"""Operators over documents against brute force, with odd rows."""

import random

import brute
import numpy as np
import pytest
from material import corpus, make_docs, work  # noqa: F401
from pyspark.sql import functions as F

from groundtrace.llm import exact_dedup, line_dedup, mixing, near_dedup, passage_dedup


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


def test_near_duplicates(make_docs, work, corpus):
    for k, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(make_docs(corpus), work, k, percent)
        assert by_id(got, "id", "n_shingles", "component", "kept") == brute.near(corpus, k, percent)


def test_near_duplicates_of_large_regions(make_docs, work):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 7)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10 ** 6)}"
        docs.append((i, " ".join(words)))
    got = near_dedup.near_duplicates(make_docs(docs), work, 3, 85)
    assert by_id(got, "id", "n_shingles", "component", "kept") == brute.near(docs, 3, 85)


def test_near_duplicates_of_pairs_on_one_template(make_docs, work):
    template = [f"t{i}" for i in range(700)]
    docs = []
    for g in range(250):
        group = template + [f"g{g}x{i}" for i in range(40)]
        docs += [(2 * g + j, " ".join(group + [f"d{g}x{j}x{i}" for i in range(90)])) for j in range(2)]
    assert near_dedup.last_orders(80) == 38
    got = near_dedup.near_duplicates(make_docs(docs), work, 1, 80)
    assert by_id(got, "id", "n_shingles", "component", "kept") == brute.near(docs, 1, 80)


def test_sketches_exclude_no_link():
    rng = np.random.default_rng(3)
    bits = lambda x, y: np.bitwise_count((x ^ y).view(np.uint64)).astype(int)
    part, over = near_dedup._PART, 0
    for i in range(300):
        values = np.unique(rng.integers(0, 2 ** 63, 1200).astype(np.uint64))
        same = int(rng.integers(1, 1000))
        x, y = values[:same + 60], np.concatenate([values[:same], values[same + 60:same + 60 + int(rng.integers(0, 90))]])
        a, b = (near_dedup.sketch(near_dedup.signature(v), v) for v in (x, y))
        apart = len(np.setxor1d(x, y))
        assert bits(a, b)[part:].sum() <= apart
        percent = int(100 * len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        over += bits(a, b)[:part].sum() > near_dedup.most_apart(percent)
    assert over == 0
    assert near_dedup.most_apart(100) == 0 and near_dedup.most_apart(85) < near_dedup.most_apart(80) < 160


def test_neighbours_in_sorted_orders(spark):
    sketch = [0] * near_dedup._SKETCH
    rows = [(key, i, 10, sketch, [d]) for key, i, d in ((1, 5, 9), (1, 6, 9), (1, 7, 2), (1, 8, 3), (1, 1, 8), (2, 9, 9))]
    rows += [(1, 2, 10, [(1 << 62) - 1] + sketch[1:], [9]), (1, 3, 90, sketch, [9])]  # not alike, too large
    frame = spark.createDataFrame(rows, "key long, id long, n long, sketch array<long>, deeper array<long>").coalesce(1)
    got = {(r.a, r.b) for r in near_dedup._neighbours(frame, 85).collect()}
    assert got <= {(a, b) for a in (5, 6, 7, 8) for b in (1, 5, 6, 7) if a > b}
    assert near_dedup._neighbours(frame.limit(0), 85).schema.simpleString() == "struct<a:bigint,b:bigint>"


def test_near_duplicates_odd_rows(make_docs, work):
    same = "one two three four five six"
    rows = [(3, same), (1, same), (1, same), (None, same), (1, "a b c d e f g"), (9, "a b c d e f g"), (None, None)]
    got = near_dedup.near_duplicates(make_docs(rows), work, 3, 85).collect()
    assert sorted((r.id is None, r.id or 0, r.n_shingles, r.component, r.kept) for r in got) == [
        (False, 1, 4, 1, True), (False, 1, 4, 1, True), (False, 1, 5, 1, True), (False, 3, 4, 1, False), (False, 9, 5, 1, False),
        (True, 0, 0, None, True), (True, 0, 4, None, True)]
    assert near_dedup.near_duplicates(make_docs([]), work).count() == 0
    kept = near_dedup.keep_documents(make_docs(rows), work)
    assert kept.columns == make_docs([]).columns and kept.count() == 5


def test_near_duplicates_of_two_sets_under_one_id(make_docs, work):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-1] + ["x"])), (3, " ".join(b[:-1] + ["x"]))]
    got = near_dedup.near_duplicates(make_docs(rows), work, 3, 85)
    assert sorted((r.id, r.component) for r in got.collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_exact_deduplication(make_docs, work, corpus, spark):
    index = exact_dedup.DigestIndex(spark, f"{work.folder}/index", 4)
    rows = corpus + [(200, corpus[0][1]), (None, corpus[0][1]), (200, corpus[0][1])]
    got = exact_dedup.deduplicate(make_docs(rows), index, work).collect()
    assert len(got) == len(rows)
    groups = {}
    for doc, text in rows:
        groups.setdefault("".join(brute.tokens(text)), []).append((-len(text or ""), doc is None, doc or 0))
    keep = {brute.sha(k): (min(v)[2], len(v)) for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == keep[bytes(r.digest).hex()]
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.id == r.keep_id for r in got if r.kept)

    again = exact_dedup.DigestIndex(spark, f"{work.folder}/index", 4)
    more = exact_dedup.deduplicate(make_docs([(500, corpus[3][1]), (501, "quite new"), (502, "quitenew")]), again, work)
    assert by_id(more, "id", "kept") == {500: (False,), 501: (True,), 502: (False,)}
    assert again.table().count() == len(groups) + 1


def test_exact_deduplication_of_a_repeated_batch(make_docs, work, spark):
    index = exact_dedup.DigestIndex(spark, f"{work.folder}/batches", 2)
    first, second = [(2, "a b"), (1, "ab"), (3, "c")], [(4, "c"), (5, "d"), (6, "d ")]

    def run(rows, batch):
        return by_id(exact_dedup.deduplicate(make_docs(rows), index, work, batch=batch), "id", "keep_id", "group_size", "kept")

    assert run(first, "one") == {2: (2, 2, True), 1: (2, 2, False), 3: (3, 1, True)}
    index.append(exact_dedup.keys_of(make_docs([(6, "d ")]), F.lit(0)).select(  # a part of a batch that died
        "digest", F.col("id").alias("keep_id"), F.col("chars").alias("keep_chars"), F.lit(2).cast("long").alias("group_size")), "two")
    wanted = {4: (3, 2, False), 5: (6, 2, False), 6: (6, 2, True)}
    assert run(second, "two") == wanted and run(second, "two") == wanted
    assert run(first, "one") == {2: (2, 2, True), 1: (2, 2, False), 3: (3, 1, True)}
    assert index.table().count() == 3


def test_exact_deduplication_keeps_rows(make_docs, work, spark):
    docs = make_docs([(2, "a b"), (1, "ab"), (1, "ab"), (None, "c"), (None, "c"), (4, None), (5, "")])
    kept = exact_dedup.keep_documents(docs, exact_dedup.DigestIndex(spark, f"{work.folder}/a", 2), work)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.text) == [(-1, "c"), (2, "a b")]
    assert kept.count() == 3
    empty = exact_dedup.keep_documents(make_docs([]), exact_dedup.DigestIndex(spark, f"{work.folder}/b", 2), work)
    assert empty.count() == 0


def test_passages(make_docs, work, corpus):
    got = passage_dedup.remove_repeats(make_docs(corpus), work)
    assert by_id(got, "id", "n_words", "n_removed", "kept_sha") == brute.passages(corpus, 13)


def test_passages_of_texts_in_pieces(make_docs, work, monkeypatch):
    monkeypatch.setattr(passage_dedup, "PIECE_WORDS", 16)
    monkeypatch.setattr(passage_dedup, "SHARD_PHRASES", 20)
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(150))
    docs = [(i, " ".join([f"{i}w{k}" for k in range(rng.randint(0, 60))] + shared.split()[rng.randint(0, 70):rng.randint(71, 150)]
                         + [f"{i}v{k}" for k in range(rng.randint(0, 60))])) for i in range(12)]
    docs += [(20, "a b " * 100), (21, "\x0b a  b\n" * 60), (22, docs[3][1]), (23, docs[3][1] + " tail")]
    got = passage_dedup.remove_repeats(make_docs(docs), work)
    assert by_id(got, "id", "n_words", "n_removed", "kept_sha") == brute.passages(docs, 13)


def test_passages_odd_rows(make_docs, work, monkeypatch):
    monkeypatch.setattr(passage_dedup, "SHARD_PHRASES", 5)  # many shards, several automata and copies for each
    monkeypatch.setattr(passage_dedup, "TASK_BYTES", 900)
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(30)] + [(40, "x " * 200), (41, "x " * 100)]
    got = passage_dedup.remove_repeats(make_docs(docs), work)
    assert by_id(got, "id", "n_words", "n_removed", "kept_sha") == brute.passages(docs, 13)
    rows = [(5, passage), (5, passage), (5, "q " + passage), (None, passage), (7, passage), (8, None)]
    got = passage_dedup.remove_repeats(make_docs(rows), work).collect()
    assert sorted((r.id or -1, r.n_words, r.n_removed) for r in got) == [
        (-1, 40, 0), (5, 40, 0), (5, 40, 0), (5, 41, 0), (7, 40, 40), (8, 0, 0)]
    assert passage_dedup.remove_repeats(make_docs([]), work).count() == 0


def test_lines(make_docs, work, corpus):
    got = line_dedup.remove_lines(make_docs(corpus), work)
    assert by_id(got, "id", "n_lines", "n_removed", "text") == brute.lines(corpus, line_dedup.MIN_CHARS)


def test_lines_with_edits(make_docs, work):
    rng = random.Random(4)
    letters = "ab c"
    docs, bases = [], ["".join(rng.choice(letters) for _ in range(n)) for n in (14, 15, 16, 17, 30, 31, 300, 520, 700)]
    for i in range(120):
        line = rng.choice(bases)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(line))
            line = line[:at] + rng.choice(["", rng.choice(letters), line[at] + rng.choice(letters)]) + line[at + 1:]
        docs.append((i, line + "\n" + rng.choice(bases)))
    got = line_dedup.remove_lines(make_docs(docs), work)
    assert by_id(got, "id", "n_lines", "n_removed", "text") == brute.lines(docs, line_dedup.MIN_CHARS)
    rows = [(None, "a line of some length"), (2, "a line of some length"), (2, "a line of some length"), (3, "\n \n")]
    got = line_dedup.remove_lines(make_docs(rows), work).collect()
    assert sorted((r.id or -1, r.n_lines, r.n_removed) for r in got) == [(-1, 1, 1), (2, 1, 0), (2, 1, 1), (3, 3, 0)]
    assert line_dedup.remove_lines(make_docs([]), work).count() == 0


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / share >= 2 * sizes[s]] if share else []
        if not over:
            target.update({s: left * weight[s] / share for s in open_})
            return target
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            full.add(s)


def test_mixing(make_docs, work, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 8)
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), None, rng.choice(["a", "B", "é", "z", None])) for i in range(200)]
    rows += [(1, None, None, "a"), (None, "x y", None, "z"), (None, "x y", None, "z")]
    got = mixing.taken_words(make_docs(rows), work, block_words=64)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.tokens(text))
    target = expected_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert taken == {s: round(t) for s, t in target.items()}
    assert all((r.first_slot is None) == (r.taken == 0) for r in found)
    again = mixing.taken_words(make_docs(rows).repartition(7), work, block_words=64)
    assert sorted(map(str, again.collect())) == sorted(map(str, found))
    assert mixing.taken_words(make_docs([]), work).count() == 0
    nothing = mixing.taken_words(make_docs([(1, "", None, "a"), (2, None, None, "b")]), work).collect()
    assert [(r.taken, r.target) for r in nothing] == [(0, 0.0), (0, 0.0)]


def test_schedule_spreads_sources(make_docs, work):
    rows = [(i, "w " * 50, None, "ab"[i % 2]) for i in range(400)]
    sized = mixing.sized(make_docs(rows), F.monotonically_increasing_id(), 1)
    targets = mixing.source_targets(work.store(sized), work)
    slots = mixing.schedule(targets, work, 100).orderBy("slot").collect()
    share = sum(r.source == "a" for r in slots) / len(slots)
    for at in range(0, len(slots) - 50, 50):
        part = sum(r.source == "a" for r in slots[at:at + 50])
        assert abs(part - 50 * share) <= 3
    assert sorted(r.block for r in slots if r.source == "a") == list(range(sum(r.source == "a" for r in slots)))


def test_mixed_documents(make_docs, work):
    rows = [(i, f"t{i} " * 40, None, "ab"[i % 2]) for i in range(50)] + [(3, "t3 " * 40, None, "b")]
    docs = make_docs(rows)
    out = mixing.mixed_documents(docs, work)
    assert out.columns == docs.columns
    words = out.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == round(1.5 * 40 * 51)
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4
    assert mixing.mixed_documents(make_docs([]), work).count() == 0


def test_lines_of_one_document_of_very_many(spark, make_docs, work):
    """9,000 lines, each with one within an edit: the work for a document grows with its lines, not with their square."""
    import hashlib as digests

    lines = [digests.md5(str(i // 2).encode()).hexdigest() + " some further words" + ("" if i % 2 else "x") for i in range(9000)]
    row = line_dedup.remove_lines(make_docs([(1, "\n".join(lines)), (2, None)]), work).filter("id = 1").first()
    assert (row.n_lines, row.n_removed, row.text) == (9000, 4500, "\n".join(lines[::2]))
