"""Vectors, pages, languages, licences and tokens."""

import hashlib
import io
import pickle
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from material import corpus, make_docs, work  # noqa: F401
from pyspark.sql import functions as F

from groundtrace.llm import language_id, license_scan, pieces, small_world, vector_dedup, warc
from groundtrace.llm.components import components
from groundtrace.llm.words import words

SF = "/root/testdata/sf0.001"


def test_components(spark, work):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(300, i) for i in range(301, 400)] + [(500, 500)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    found = components(spark.createDataFrame(edges, "a long, b long"), work)
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert {r.node: r.component for r in found.collect()} == brute.closure(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long"), work).count() == 0


@pytest.mark.parametrize("each, tables", [(1 << 16, 2), (40, None)])
def test_components_of_a_long_chain(spark, work, monkeypatch, each, tables):
    """What one task holds is settled there, without rounds over the table; several tasks give the same."""
    monkeypatch.setattr("groundtrace.llm.components.EDGES", each)
    edges = [(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(500)] + [(2000, 2001)] * 3
    found = components(spark.createDataFrame(edges, "a long, b long"), work)
    assert tables is None or work._tables == tables
    assert {r.node: r.component for r in found.collect()} == brute.closure({n for e in edges for n in e}, edges)


def test_words_in_small_pieces(monkeypatch):
    from groundtrace.llm import words as module

    texts = ["a bc  d", None, "", "été\x0bx", "x" * 5000 + " y", " lead", "tail "] + ["ab cd"] * 50
    whole = words(pa.array(texts, pa.string()))
    monkeypatch.setattr(module, "PIECE", 7)
    small = words(pa.array(texts, pa.string()))
    assert (whole.hash == small.hash).all() and (whole.start == small.start).all()
    counts = np.diff(whole.first)
    assert counts.tolist() == [len(brute.tokens(t)) for t in texts]
    assert len(set(whole.hash.tolist())) == len({w for t in texts for w in brute.tokens(t)})


def links_of(rows, cosine):
    good = {i: np.array(v, float) for i, (_, v) in enumerate(rows)
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]):
                a, b = good[i], good[j]
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    out.append((i, j))
    return out


def test_vectors(spark, work):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.12).tolist()) for i in range(300)]
    rows += [(300 + i, rng.normal(size=16).tolist()) for i in range(300)] + [(700 + i, rows[7][1]) for i in range(40)]
    rows += [(800, None), (801, []), (802, [0.0] * 16), (803, [float("nan")] * 16), (804, [None] + [1.0] * 15),
             (805, [float("inf")] * 16), (806, [1.0, 2.0]), (807, [2.0, 4.0])]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id long, cid long")
    got = {r.id: r for r in vector_dedup.near_vectors(frame, work).collect()}
    links = links_of(rows, 0.9)
    degree = dict.fromkeys(range(len(rows)), 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    found = brute.closure([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    right = sum(got[r[0]].n_links for r in rows)
    assert right >= 0.99 * 2 * len(links) and all(got[rows[i][0]].n_links <= n for i, n in degree.items())
    assert all(got[i].component == c and got[i].kept == (i == c) for i, c in found.items())


def test_vectors_odd_rows(spark, work):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.1]), (5, [-1.0, 0.0]), (None, None)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), work).collect()
    assert sorted((r.id or 0, r.n_links, r.component or 0, r.kept) for r in got) == [
        (0, 0, 0, True), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (5, 0, 5, True)]
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), work).count() == 0


def test_graph_whose_upper_layer_outgrows_a_batch(monkeypatch):
    """While a layer is filled, the layer above may lead to members that are not placed yet."""
    monkeypatch.setattr(small_world, "BATCH", 8)
    rng = np.random.default_rng(5)
    x = vector_dedup.unit(rng.normal(size=(60, 16)).repeat(10, axis=0) + rng.normal(size=(600, 16)) * 0.1)
    graph = small_world.Graph(x, np.repeat([2, 1, 0], [20, 100, 480]))
    assert graph.sizes == [600, 120, 20]
    q, m = graph.within(x, 0.9, 16)
    assert len(q) >= 0.99 * (x @ x.T >= 0.9).sum() and (x[q] * x[m]).sum(axis=1).min() > 0.8999


def test_graphs_travel_in_pieces(spark, work):
    """No row carries a whole graph, and the pieces make the graph again."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 256)).repeat(4, axis=0) + rng.normal(size=(1600, 256)) * 0.1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    members = frame.select(F.lit(7).cast("long").alias("shard"), F.col("vec_id").alias("cid"), F.col("embedding").alias("vector"))
    cut = sorted((r.piece, r.graph) for r in vector_dedup._build(members, work).collect())
    assert len(cut) > 4 and max(len(g) for _, g in cut) <= vector_dedup.PIECE
    names, vectors, sizes, _ = pickle.loads(b"".join(g for _, g in cut))
    assert sorted(names) == list(range(1600)) and np.allclose(vectors, vector_dedup.unit(x)[names]) and sizes[0] == 1600
    u = vector_dedup.unit(x)
    got = {r.id: (r.n_links, r.component) for r in vector_dedup.near_vectors(frame, work).collect()}
    assert got == {i: (int(n), i // 4 * 4) for i, n in enumerate((u @ u.T >= 0.9).sum(axis=1) - 1)}


def test_warc_round_trip(spark, work, monkeypatch):
    long = "<p>é" * 60
    rows = [(1, "http://a/é x", long, 1), (2, None, long, 1), (3, "http://b", None, 1), (4, "c", "", 1), (5, "d", "short", 1),
            (6, "e", "short", 1), (None, "f", long, 1), (2, "g", long, 1), (8, "h", "<b>" * 400_000, 1), (8, "h", "a\r\n\r\nb" * 50, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(2)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 600)
    manifest = warc.write(pages, work)
    assert manifest.count() > 2 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                 for r in warc.resolved(work.store(warc.read(manifest))).collect())
    expected = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        revisit = html == long and page != 1
        expected.append((page or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                         1 if revisit else None))
    assert got == sorted(expected, key=lambda r: r[:3])
    empty = warc.write(spark.createDataFrame([], pages.schema), work)
    assert warc.read(empty).count() == 0


def test_warc_reader_finds_damage():
    data = warc._record(1, "http://a", b"payload", "response", hashlib.sha256(b"payload").hexdigest(), None)
    wrong = warc._record(2, "http://a", b"payload", "response", hashlib.sha256(b"other").hexdigest(), None)
    got = list(warc.read_archive(io.BytesIO(data + wrong), payloads=True))
    assert [(r[1], r[3]) for r in got] == [(7, True), (7, False)] and got[0][4].endswith(b"payload")
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-20])))
    with pytest.raises(Exception):
        list(warc.read_archive(io.BytesIO(data + b"junk")))


def test_language_held_out_accuracy(spark, make_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.fit(docs.filter(~held_out))
    got = language_id.predict(docs.filter(held_out), model).select(
        F.avg((F.col("language.lang") == F.col("lang")).cast("int")), F.avg(F.col("language.accepted").cast("int"))).first()
    assert got[0] >= 0.97 and got[1] >= 0.97
    rows = [(1, None), (2, ""), (3, "12 !? \n"), (4, "the of and with " * 60_000), (5, "the of and with"), (5, "the of and with")]
    found = {r.doc_id: r for r in language_id.predict(make_docs(rows), model).collect()}
    assert all(found[i].language.lang == "und" and found[i].language.score == 0 for i in (1, 2, 3))
    assert found[4].language.lang == found[5].language.lang == "en"
    assert 0 <= found[5].language.score <= 1
    assert language_id.predict(make_docs([]), model).count() == 0


def test_language_rejects_what_it_never_learned(spark, make_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    polish = ("Wszyscy ludzie rodz\u0105 si\u0119 wolni i r\u00f3wni pod wzgl\u0119dem swej godno\u015bci i swych praw. S\u0105 oni obdarzeni rozumem "
              "i sumieniem i powinni post\u0119powa\u0107 wobec innych w duchu braterstwa. ") * 3
    rng = random.Random(2)
    noise = " ".join("".join(rng.choice("qwertyuiopasdfghjklzxcvbnm") for _ in range(rng.randint(3, 9))) for _ in range(60))
    got = language_id.predict(make_docs([(1, polish), (2, noise)]), model).collect()
    assert not any(r.language.accepted for r in got)
    kept = language_id.predict(docs.filter("lang is not null"), model).agg(F.avg(F.col("language.accepted").cast("int"))).first()[0]
    assert kept >= 0.99
    short = language_id.predict(docs.filter("lang is not null").withColumn("text", F.substring_index("text", " ", 6)), model)
    assert short.agg(F.avg(F.col("language.accepted").cast("int"))).first()[0] >= 0.95


def test_language_without_labels(make_docs):
    rows = [(1, "some words", None), (2, "more words", None)]
    got = language_id.predict(make_docs(rows), language_id.fit(make_docs(rows))).collect()
    assert {r.language.lang for r in got} == {"und"}
    one = [(1, "some words", "xx"), (2, None, "yy")]
    model = language_id.fit(make_docs(one))
    assert [r.language.lang for r in language_id.predict(make_docs(one), model).orderBy("doc_id").collect()] == ["xx", "und"]
    assert language_id.keep_known(make_docs(one)).columns == make_docs(one).columns


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.read()


def best_score(text, vocabulary):
    """Greatest total piece score of a text by dynamic programming over all substrings."""
    scores = {p: s for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds) if k == pieces.NORMAL}
    unknown, longest = min(scores.values()) - pieces.UNKNOWN_PENALTY, max(map(len, scores))
    best = [0.0]
    for end in range(1, len(text) + 1):
        options = [best[at] + scores[text[at:end]] for at in range(max(0, end - longest), end) if text[at:end] in scores]
        if text[end - 1] not in scores:
            options.append(best[end - 1] + unknown)
        best.append(max(options))
    return best[-1]


def score_of(text, vocabulary):
    coder = pieces.coder(vocabulary)
    total, unknown = 0.0, coder.unknown_score
    at = 0
    ids = coder.encode(text)
    for i in ids:
        if vocabulary.kinds[i] == pieces.NORMAL:
            total += vocabulary.scores[i]
        at += 1
    lost = sum(c not in coder.single for c in pieces.MARK + text.replace(" ", pieces.MARK))
    return total + lost * unknown


TEXTS = ["the theory of  it", "a", " leading", "tail ", "日本 😀 x\n\ty", "Été où naïve", "hello   world" * 9, "\x00\x7f ok", "ﬁ Å"]


def test_tokens_take_the_best_path(vocabulary):
    for text in TEXTS:
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        assert score_of(text, vocabulary) == pytest.approx(best_score(marked, vocabulary)), text
        assert pieces.coder(vocabulary).decode(pieces.coder(vocabulary).encode(text)) == text


def test_tokens_of_documents(spark, make_docs, vocabulary, corpus):
    docs = make_docs(corpus + [(300, "x" * 100_000)])
    out = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    assert out.filter(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert out.filter(F.coalesce("text", F.lit("")) == "").select(F.max(F.size("ids"))).first()[0] == 0
    assert pieces.encode(make_docs([]), vocabulary).count() == 0
    chunked = pieces.coder(vocabulary)
    plain = pieces.Coder(vocabulary)
    plain.chunks = None
    for _, text in corpus[:40]:
        assert chunked.encode(text) == plain.encode(text)


def test_licences(spark, work):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [("a/LICENSE", apache), ("a/x.py", "print(1)\n\nsome code"), ("a/b/c/y.py", None), ("a/b/z.py", "code\n# Released under the MIT license!\n" + "more lines of other code\n" * 9),
            ("a/b/d/COPYING", "All rights reserved."), ("a/b/d/e/v.py", ""), ("top.py", "nothing here"), (None, apache),
            ("a/x.py", "print(1)\n\nsome code"), ("ab/w.py", "the license of the version")]
    files = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, dir int")
    got = license_scan.with_inherited(license_scan.scan(files), work).collect()
    found = sorted((r.path or "", r.own, r.licence, r.given_by) for r in got)
    assert found == sorted([
        ("", "Apache-2.0", "Apache-2.0", None), ("a/LICENSE", "Apache-2.0", "Apache-2.0", None),
        ("a/b/c/y.py", None, "Apache-2.0", "a"), ("a/b/d/COPYING", "Proprietary", "Proprietary", None),
        ("a/b/d/e/v.py", None, "Proprietary", "a/b/d"), ("a/b/z.py", "MIT", "MIT", None), ("a/x.py", None, "Apache-2.0", "a"),
        ("a/x.py", None, "Apache-2.0", "a"), ("ab/w.py", None, None, None), ("top.py", None, None, None)],
        key=lambda r: (r[0], str(r[1])))
    line = {r.path: r.line for r in got}
    assert line["a/b/z.py"] == 1 and line["a/LICENSE"] == 0 and line["a/x.py"] == -1
    empty = files.limit(0)
    assert license_scan.with_inherited(license_scan.scan(empty), work).count() == 0


def test_wrapped_licence_headers(spark):
    gnu = ("# Copyright 2020 Some Body\n#\n# This {0} is free software{1} you can redistribute it and/or modify\n"
           "# it under the terms of the GNU {2}General Public License as published by\n"
           "# the Free Software Foundation{3} either version {4} of the License, or\n# (at your option) any later version.\n"
           "#\nimport os\nprint(os.name)\n")
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\n"
           "of this software and associated documentation files (the \"Software\"), to deal\n"
           "in the Software without restriction, including without limitation the rights\n")
    texts = {"GPL-3.0": gnu.format("program", ":", "", ",", 3), "AGPL-3.0": gnu.format("program", ":", "Affero ", ",", 3),
             "LGPL-3.0": gnu.format("program", ":", "Lesser ", ",", 3), "GPL-2.0": gnu.format("program", ";", "", ";", 2),
             "LGPL-2.1": gnu.format("library", ";", "Lesser ", ";", 2.1), "MIT": mit, "none": "import os\n" * 5}
    rows = list(texts.items()) + [(f"x{i}", f"words of file {i}\nand of the free version") for i in range(60)]
    found = {r.path: (r.own, r.line) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: found[p][0] for p in texts} == {p: p if p != "none" else None for p in texts}
    assert found["AGPL-3.0"][1] == 2 and found["MIT"][1] == 0
    assert all(found[f"x{i}"] == (None, -1) for i in range(60))


def test_licence_cosine_by_hand(spark):
    texts = ["alpha beta", "All rights reserved.", "all rights reserved to beta and gamma", None]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: r for r in license_scan.scan(files).collect()}
    idf = {w: np.log(5 / 3) + 1 for w in ("all", "rights", "reserved")}
    idf |= {"to": np.log(5 / 2) + 1, "and": np.log(5 / 2) + 1}  # in a template, in one file
    seen = np.array([idf[w] for w in ("all", "rights", "reserved")])
    rest = np.array([idf["to"], idf["and"], np.log(5) + 1, np.log(5) + 1])
    cosine = np.linalg.norm(seen) / np.sqrt((seen ** 2).sum() + (rest ** 2).sum())
    assert got["1"].own == "Proprietary" and got["1"].own_cosine == pytest.approx(1)
    if cosine >= license_scan.FILE_COSINE:
        assert got["2"].file_cosine == pytest.approx(cosine)
    else:
        assert got["2"].file is None
