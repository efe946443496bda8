"""Compression scores: whole texts, held-out order, samples and odd tables."""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from groundtrace.llm import quality as qu
from groundtrace.llm.queries import op13_quality

SF = "/root/testdata/sf0.01"


def test_sizes_are_those_of_whole_texts():
    words = ["good", "text", "that", "reads", "well", "!!", "NOISE", "zzz"]
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(words[:5] if i % 2 else words[5:], 200)).encode() for i in range(80)]
    model = qu.train(texts, np.array([i % 2 for i in range(80)]), (40, 40))
    long = b"good text that reads well " * 20000
    good, bad = qu.sizes(pa.array([long.decode(), "", None, "zzz"]), model)

    def plain(text, dictionary):
        compressor = zstandard.ZstdCompressor(level=qu.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False,
                                              write_content_size=False, write_dict_id=False)
        return sum(len(compressor.compress(text[i:i + qu.PIECE])) for i in range(0, len(text), qu.PIECE))

    assert good.tolist() == [plain(t, model.good) for t in (long, b"", b"", b"zzz")]
    assert bad.tolist() == [plain(t, model.bad) for t in (long, b"", b"", b"zzz")]
    score = model.score(qu.difference(good, bad))
    assert score[0] > 0.9 and 0 < score[1] == score[2] < 1
    assert model.score(np.array([-0.5, 0.0, 0.5])).tolist() == sorted(model.score(np.array([-0.5, 0.0, 0.5])).tolist())


def test_held_out_rows(spark):
    rows = op13_quality(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    judged = rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = judged.score[judged.quality == 1].to_numpy(), judged.score[judged.quality == 0].to_numpy()
    area = ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean())
    assert area > 0.97 and (judged.predicted == judged.quality).mean() > 0.93
    assert abs(judged.score.mean() - judged.quality.mean()) < 0.06  # calibrated on the whole
    again = op13_quality(spark, SF)
    assert rows.exceptAll(again).count() == 0


def test_odd_tables(spark):
    shape = "doc_id long, text string, doc long, quality string, k int"
    docs = spark.createDataFrame([(i, t, 1, "q", 2) for i, t in [
        (1, "fine words here"), (1, "fine words here"), (1, "other words"), (2, "BAD!!"), (3, None), (None, "no key"), (4, ""), (5, "both")]], shape)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (5, 1), (5, 0), (None, 1), (9, 0), (2, None), (1, 7)], "doc_id long, quality int")
    model = qu.fit(docs, labels)
    rows = qu.score(docs, model).select("doc.*", F.col("quality.score").alias("score")).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows) and {r.quality for r in rows} == {"q"}
    assert len({r.score for r in rows if not r.text}) == 1
    assert qu.fit(docs, labels.filter("quality = 1")).constant == 1.0
    assert qu.fit(docs, labels.limit(0)).constant == 0.5 and qu.fit(docs.limit(0), labels).constant == 0.5
    assert qu.score(docs.limit(0), model).count() == 0


def test_fit_takes_bounded_parts_of_long_texts(spark):
    rows = [(i, ("good words in a row " if i % 2 else "BAD!! NOISE!! ") * 4000) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = qu.fit(docs, labels, rows=10)
    scores = {r.doc.doc_id % 2: r.quality.score for r in qu.score(docs, model).collect()}
    assert scores[1] > 0.8 > 0.2 > scores[0]
