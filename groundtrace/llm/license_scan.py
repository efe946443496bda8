"""Licence scans: TF-IDF cosine to licence templates, then inheritance from the nearest directory.

Every line of a file, every run of lines as long as a wrapped notice can be, and the file as a whole, is a sparse vector
of word counts times inverse document frequency, held against short templates by cosine. Lines without words are
skipped in runs. The best line or run of at least ``LINE_COSINE`` is the file's own licence; a file that as a whole reaches ``FILE_COSINE`` is a licence file of its directory. A file without a licence of its own takes
that of the nearest directory above it, found by joins on the paths of the directories.

Frequencies are counted over all files for the words of the templates; other words count as unseen. Lines without one
of the templates' telling words are passed over: without them the cosine stays below the threshold by the
Cauchy-Schwarz bound, whatever else they hold.

Defined cases: null and empty texts have no licence of their own. A null path neither gives nor takes one. Ties go to the
earlier template, then the earlier line, then the shorter run; of several licence files in a directory the closest counts, then the
smallest path. Repeated rows have equal results. Texts are read whole. An empty table gives an empty result. Extra
columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace.llm.tables import Work, arrow_batches
from groundtrace.llm.words import buffers, words

LINE_COSINE = 0.7
FILE_COSINE = 0.5
RUNS = 4096

# Notices by which licences are stated.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
                "(at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                 "License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

_FOLD = np.full(256, 32, np.uint8)  # letters folded, digits and other bytes kept, punctuation and space as space
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[10] = 10
_U = np.uint64


class Templates:
    """Template vectors over their own words, once the words' document frequencies are known."""

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        w = words(pa.array([text for _, text in templates], pa.string()), table=_FOLD)
        self.terms, place = np.unique(w.hash, return_inverse=True)
        self.counts = np.zeros((len(self.terms), len(templates)))
        for j in range(len(templates)):
            np.add.at(self.counts[:, j], place[w.first[j]:w.first[j + 1]], 1)

    def weigh(self, frequency: np.ndarray, files: int, least: float) -> None:
        self.idf = np.log((1 + files) / (1 + frequency)) + 1
        self.unseen = np.log(1 + files) + 1
        vectors = self.counts * self.idf[:, None]
        self.vectors = vectors / np.linalg.norm(vectors, axis=0)
        common, left = np.zeros(len(self.terms), bool), np.zeros(len(self.names))
        for term in np.argsort(self.idf, kind="stable"):
            left = left + self.vectors[term] ** 2
            if left.max() >= least ** 2:
                break
            common[term] = True
        self.telling = ~common
        self.longest = int(self.counts.sum(axis=0).max())

    def index(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def closest(self, unit: np.ndarray, hashes: np.ndarray, term: np.ndarray):
        """(unit, template, cosine) for the units, lines or files, that hold a telling word; units ascend."""
        telling = (term >= 0) & self.telling[np.maximum(term, 0)]
        marked = np.unique(unit[telling])
        use = np.isin(unit, marked)
        unit, hashes, term = unit[use], hashes[use], term[use]
        if not len(unit):
            return marked, np.zeros(0, np.int64), np.zeros(0)
        order = np.lexsort((hashes, unit))
        unit, hashes, term = unit[order], hashes[order], term[order]
        first = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (hashes[1:] != hashes[:-1])])
        tf = np.diff(np.r_[first, len(unit)])
        unit, term = unit[first], term[first]
        weight = tf * np.where(term >= 0, self.idf[np.maximum(term, 0)], self.unseen)
        start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        norm = np.sqrt(np.add.reduceat(weight ** 2, start))
        part = np.where((term >= 0)[:, None], self.vectors[np.maximum(term, 0)], 0) * weight[:, None]
        cosine = np.add.reduceat(part, start, axis=0) / norm[:, None]
        best = cosine.argmax(axis=1)
        return marked, best, cosine[np.arange(len(best)), best]


def _runs(known: Templates, line: np.ndarray, doc: np.ndarray, term: np.ndarray, least: float):
    """First and last + 1 word of the runs of two or more lines that may reach ``least``, by first line, then length.

    Words of a run that repeat only add to its norm, so sums over lines bound the cosine from above. A run begins and
    ends with a line that holds a template word, and has at most twice as many words as the longest template.
    """
    none = np.zeros(0, np.int64)
    if not len(line):
        return none, none
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    edge = np.r_[first, len(line)]
    n, of = len(first), doc[first]
    seen = np.flatnonzero(term >= 0)
    row = (np.searchsorted(first, seen, "right") - 1)
    weight = known.idf[term[seen]]
    dots = np.stack([np.bincount(row, weight * v[term[seen]], n) for v in known.vectors.T], axis=1)
    square = np.add.reduceat(np.where(term >= 0, known.idf[np.maximum(term, 0)], known.unseen) ** 2, first)
    holds = dots.max(axis=1) > 0
    at, size = np.flatnonzero(holds), 1
    dot, norm = dots[at].copy(), square[at].copy()
    begin, end = [], []
    while True:
        to = at + size
        go = to < n
        go[go] = (of[to[go]] == of[at[go]]) & (edge[to[go] + 1] - edge[at[go]] <= 2 * known.longest)
        at, dot, norm, to = at[go], dot[go], norm[go], to[go]
        if not len(at):
            break
        dot += dots[to]
        norm += square[to]
        size += 1
        hit = holds[to] & (dot.max(axis=1) >= (least - 1e-9) * np.sqrt(norm))
        begin.append(edge[at[hit]])
        end.append(edge[to[hit] + 1])
    if not begin:
        return none, none
    begin, end = np.concatenate(begin), np.concatenate(end)
    order = np.lexsort((end, begin))
    return begin[order], end[order]


def _frequencies(files: DataFrame, templates: Templates, text_col: str) -> tuple[np.ndarray, int]:
    """Files that hold each template word, and the number of files: one small row for each batch."""
    size = len(templates.terms)

    def run(batches):
        for batch in batches:
            w = words(batch.column(0), table=_FOLD)
            term = templates.index(w.hash)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
            pair = np.unique(doc[term >= 0] * size + term[term >= 0])
            n = np.bincount(pair % size, minlength=size) if len(pair) else np.zeros(size, np.int64)
            yield pa.record_batch([pa.array(np.arange(size + 1)), pa.array(np.append(n, batch.num_rows).astype(np.int64))],
                                  names=["term", "n"])

    sums = files.select(F.col(text_col)).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    out = np.zeros(size + 1, np.int64)
    for term, n in sums:
        out[term] = n
    return out[:size], int(out[size])


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per file: path, own (licence or null), own_cosine, line (its number from 0), file (licence of the whole), file_cosine."""
    arrow_batches(files.sparkSession)
    known = Templates(templates)
    known.weigh(*_frequencies(files, known, text_col), min(LINE_COSINE, FILE_COSINE))
    names = np.array(known.names, object)

    def run(batches):
        for batch in batches:
            w = words(batch.column(1), table=_FOLD)
            n, term = batch.num_rows, known.index(w.hash)
            doc = np.repeat(np.arange(n), np.diff(w.first))
            breaks = np.flatnonzero(w.data == 10)
            line = np.searchsorted(breaks, w.start) + doc  # ascends; differs between texts
            own, score, place = np.full(n, None, object), np.zeros(n), np.full(n, -1, np.int64)
            unit, best, cosine = known.closest(line, w.hash, term)
            good = cosine >= LINE_COSINE
            unit, best, cosine = unit[good], best[good], cosine[good]
            at = doc[np.searchsorted(line, unit)] if len(unit) else unit
            base = np.searchsorted(breaks, buffers(batch.column(1))[1][:-1])
            start, end = _runs(known, line, doc, term, LINE_COSINE)
            for k in range(0, len(start), RUNS):  # words of runs overlap: some runs at a time
                s, size = start[k:k + RUNS], (end - start)[k:k + RUNS]
                run_of = np.repeat(np.arange(len(s)), size)
                word = np.arange(len(run_of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)
                u, b, c = known.closest(run_of, w.hash[word], term[word])
                good = c >= LINE_COSINE
                unit, at = np.r_[unit, line[s[u[good]]]], np.r_[at, doc[s[u[good]]]]
                best, cosine = np.r_[best, b[good]], np.r_[cosine, c[good]]
            order = np.argsort(unit, kind="stable")
            for u, d, b, c in zip(unit[order], at[order], best[order], cosine[order]):
                if c > score[d]:
                    own[d], score[d], place[d] = names[b], c, u - d - base[d]
            whole, whole_score = np.full(n, None, object), np.zeros(n)
            unit, best, cosine = known.closest(doc, w.hash, term)
            good = cosine >= FILE_COSINE
            whole[unit[good]], whole_score[unit[good]] = names[best[good]], cosine[good]
            yield pa.record_batch(
                [batch.column(0), pa.array(own, pa.string()), pa.array(score), pa.array(place),
                 pa.array(whole, pa.string()), pa.array(whole_score)],
                names=["path", "own", "own_cosine", "line", "file", "file_cosine"])

    return files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInArrow(
        run, "path string, own string, own_cosine double, line long, file string, file_cosine double")


def directory(path: Column) -> Column:
    """The part before the last slash; empty for a file at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def with_inherited(scanned: DataFrame, work: Work) -> DataFrame:
    """Add ``licence`` and ``given_by``: null for an own licence, else the directory that gives it."""
    scanned = work.store(scanned.withColumn("dir", directory(F.col("path"))))
    given = scanned.filter("file is not null and dir is not null").groupBy(F.col("dir").alias("above")).agg(
        F.min_by("file", F.struct(-F.col("file_cosine"), F.col("path"))).alias("licence"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    dirs = scanned.filter("dir is not null").select("dir").distinct().select("dir", F.explode(ancestors).alias("a")).select(
        "dir", "a.*")
    nearest = dirs.join(given, "above").groupBy("dir").agg(
        F.max_by(F.struct("above", "licence"), "depth").alias("best")).withColumnRenamed("dir", "d")
    joined = scanned.join(nearest, F.col("dir") == F.col("d"), "left")
    inherits = F.col("own").isNull()
    return joined.select("path", "own", "own_cosine", "line", "file", "file_cosine",
                         F.coalesce("own", "best.licence").alias("licence"),
                         F.when(inherits, F.col("best.above")).alias("given_by"))
