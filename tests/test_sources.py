"""Readers, sanitising, text forms, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from groundtrace import schema
from groundtrace.operators import prepare as pr
from groundtrace.operators.labels import get_labels
from groundtrace.sources import events as src
from groundtrace.sources import sinks

LINES = [
    {"EventID": 1, "EventTime": "2020-05-01 22:56:35", "Image": "C:\\Windows\\cmd.exe", "CommandLine": "cmd /c dir",
     "ProcessId": "1150", "User": "A\\b", "SourcePort": "x", "_label": "benign", "prompt": "p", "other": 1,
     schema.REVIEWER_SOURCE_FIELD: {"predicted_label": "malicious", "reason": "Odd.", "confidence": "high"}},
    {"EventID": "3", "commandLine": "net view", "user": "C\\d", "processId": 7, "SourceImage": "C:\\x.exe",
     "DestinationPort": 443, "_label": "malicious", "_attack_technique": "t"},
]


@pytest.fixture
def folder(tmp_path):
    text = "\n\n".join(json.dumps(x) for x in LINES) + "\n   \n"
    (tmp_path / "events.jsonl").write_text(text)
    return str(tmp_path)


def test_read_and_sanitise(spark, folder):
    raw = src.read_events(spark, folder)
    assert raw.count() == 2 and schema.REVIEWER in raw.columns
    rows = {r["EventID"]: r for r in pr.prepare_events(raw, ()).collect()}
    assert set(rows[1].asDict()) == set(schema.ALLOWED_FIELDS)
    assert (rows[1]["ProcessId"], rows[1]["SourcePort"], rows[3]["DestinationPort"]) == (1150, None, 443)
    assert rows[3]["CommandLine"] is None  # the other spelling is not read here


def test_spellings(spark, folder):
    raw = src.read_events(spark, folder, spellings=True)
    rows = {r["EventID"]: r for r in pr.prepare_events(raw, ("_label",)).collect()}
    assert (rows[3]["CommandLine"], rows[3]["User"], rows[3]["ProcessId"]) == ("net view", "C\\d", 7)
    assert rows[1]["CommandLine"] == "cmd /c dir" and rows[3]["_label"] == "malicious"


def test_bad_line_fails_or_is_kept(spark, folder, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"EventID": 1,,}\n')
    with pytest.raises(Exception):
        src.read_events(spark, folder).collect()
    with pytest.raises(Exception):
        src.read_events(spark, folder, spellings=True).collect()
    kept = src.read_events(spark, folder, mode="PERMISSIVE", corrupt_column="bad").cache()
    assert kept.filter("bad IS NOT NULL").count() == 1


def test_texts(spark, folder):
    raw = src.read_events(spark, folder).withColumn("event_key", F.col("EventID"))
    events = pr.prepare_events(get_labels(raw), ("event_key", "label", schema.REVIEWER))
    pair = pr.distillation_pairs(events).collect()
    assert len(pair) == 1
    assert pair[0]["prompt"] == "[2020-05-01 22:56:35] | PID=1150 | User=A\\b | Image=C:\\Windows\\cmd.exe | CMD=cmd /c dir"
    assert pair[0]["response"] == "Label: malicious. Odd."
    assert pair[0]["text"] == f"{pair[0]['prompt']} <|endoftext|> Label: malicious. Odd. <|endoftext|>"
    texts = [r[0] for r in events.select(pr.embedding_text(events)).collect()]
    assert texts[0] == "Command: cmd /c dir | Image: C:\\Windows\\cmd.exe | User: A\\b"
    shot = pr.event_snapshot(events).filter("event_key = 3").first()
    assert (shot["image"], shot["user"], shot["command_line"]) == ("C:\\x.exe", "", "")


def test_sinks_round_trip(spark, folder, tmp_path):
    raw = src.read_events(spark, folder)
    out = str(tmp_path / "out")
    sinks.write_disagreement_csv(raw, out + "/csv")
    rows = spark.read.option("header", True).option("escape", '"').csv(out + "/csv").collect()
    assert len(rows) == 2  # a missing verdict differs from the truth too
    verdict = json.loads(next(r[schema.REVIEWER] for r in rows if r[schema.REVIEWER]))
    assert verdict["reason"] == "Odd."
    sinks.write_json_lines(raw.select("EventID", schema.REVIEWER), out + "/json")
    back = spark.read.json(out + "/json")
    assert back.filter(F.col("reviewer.confidence") == "high").count() == 1
    sinks.write_parquet(raw.select("EventID", "CommandLine"), out + "/parquet")
    assert src.read_event_parquet(spark, out + "/parquet").count() == 2


def test_content_keys(spark):
    rows = spark.createDataFrame([("x", 1)] * 50 + [("y", 2), (None, 3)], "a string, b int").repartition(4)
    keyed = pr.with_event_key(rows)
    assert keyed.count() == 52 and keyed.select("event_key").distinct().count() == 52
    assert keyed.filter("a = 'x'").count() == 50
    again = pr.with_event_key(rows.repartition(3))
    assert keyed.select("event_key").exceptAll(again.select("event_key")).count() == 0


@pytest.mark.parametrize("spellings", [False, True])
def test_json_stream(spark, folder, tmp_path, spellings):
    from groundtrace.streaming.score import heuristic_stream, write_scores

    stream = src.read_event_stream(spark, folder + "/*.jsonl", spellings)
    scores = heuristic_stream(stream, ("_label",))
    out = str(tmp_path / "scores")
    write_scores(scores, out, str(tmp_path / "checkpoint")).awaitTermination()
    batch = heuristic_stream(src.read_events(spark, folder + "/*.jsonl", spellings), ("_label",))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("spellings", [False, True])
def test_bad_lines(spark, tmp_path, spellings):
    """Bad lines fail by default, in batch and stream; a PERMISSIVE read hands them to a side output."""
    folder = tmp_path / "bad"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"CommandLine": "cmd /c dir", "EventID": 1}\n{"CommandLine": broken\n\n')
    with pytest.raises(Exception):
        src.read_events(spark, str(folder), spellings).select("CommandLine", "Image").collect()
    loose = src.read_events(spark, str(folder), spellings, "PERMISSIVE", "_line").cache()
    good, bad = src.split_corrupt(loose, "_line")
    assert [r["CommandLine"] for r in good.collect()] == ["cmd /c dir"]
    assert [r["line"] for r in bad.collect()] == ['{"CommandLine": broken']

    def drain(frame, name):
        out = str(tmp_path / name)
        query = frame.writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out)
        query.awaitTermination()
        return spark.read.parquet(out).collect()

    with pytest.raises(Exception):
        drain(src.read_event_stream(spark, str(folder), spellings), "strict")
    stream = src.read_event_stream(spark, str(folder), spellings, mode="PERMISSIVE", corrupt_column="_line")
    good, bad = src.split_corrupt(stream, "_line")
    assert [r["CommandLine"] for r in drain(good, "good")] == ["cmd /c dir"]
    assert [r["line"] for r in drain(bad, "lines")] == ['{"CommandLine": broken']


def test_stream_without_a_key(spark, folder, tmp_path):
    from groundtrace.streaming.score import heuristic_stream, write_scores

    out = str(tmp_path / "scores")
    stream = src.read_event_stream(spark, folder + "/*.jsonl")
    write_scores(heuristic_stream(stream), out, str(tmp_path / "checkpoint")).awaitTermination()
    batch = heuristic_stream(src.read_events(spark, folder + "/*.jsonl"))
    keys = [r["event_key"] for r in spark.read.parquet(out).collect()]
    assert keys and all(len(k) == 64 for k in keys)
    assert sorted(keys) == sorted(r["event_key"] for r in batch.collect())


def test_content_keys_in_steps(spark, monkeypatch):
    monkeypatch.setattr(pr, "EXPAND", 7)
    rows = spark.range(100).select(F.lit("same").alias("a"))
    keyed = pr.with_event_key(rows)
    assert keyed.count() == 100 and keyed.select("event_key").distinct().count() == 100


def test_two_sinks_survive_a_broken_batch(spark, tmp_path):
    """A batch that fails between its sinks is run again under its number: no row twice, none lost."""
    from groundtrace.streaming import score as st

    (tmp_path / "in").mkdir()
    for i in range(4):
        lines = [json.dumps({"event_key": 10 * i + k, "commandLine": f"net view {k}"}) for k in range(3)] + ['{"event_key": 1,,']
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(lines))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    calls = []

    def breaking(events):
        calls.append(1)
        scored = st.heuristic_stream(events)
        if len(calls) == 2:
            scored.write.parquet(f"{out}/scores/batch=1")  # half of the batch's work is there when it dies
            raise RuntimeError("lost")
        return scored

    arguments = {"files_per_trigger": 1, "extra": {"event_key": "bigint"}}
    with pytest.raises(Exception, match="lost"):
        st.score_json_stream(spark, source, out, checkpoint, breaking, **arguments).awaitTermination()
    st.score_json_stream(spark, source, out, checkpoint, st.heuristic_stream, **arguments).awaitTermination()
    scores, bad = st.read_batches(spark, out, "scores"), st.read_batches(spark, out, "bad_lines")
    assert sorted(r.event_key for r in scores.collect()) == [10 * i + k for i in range(4) for k in range(3)]
    assert bad.count() == 4 and {r.line for r in bad.collect()} == {'{"event_key": 1,,'}
    assert scores.select("batch").distinct().count() == 4


def test_single_event_timings(spark, tmp_path):
    from groundtrace.operators.metrics import timing_summary
    from groundtrace.streaming import score as st

    events = spark.createDataFrame([(i, f"net view {i}") for i in range(5)], "event_key long, CommandLine string")
    timings = st.single_event_timings(spark, events, str(tmp_path / "one"), st.heuristic_stream, 3)
    assert [(r.stage, r.rows) for r in timings.collect()] == [("single_event", 1)] * 3
    assert timing_summary(timings).first()["runs"] == 3
