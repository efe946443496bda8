"""Streaming scoring (T1): the batch projections on a streaming input; stateless, append mode."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundtrace.operators.forest import ForestModel
from groundtrace.operators.prepare import prepare_events, with_content_key
from groundtrace.operators.triage import heuristic_verdict
from groundtrace.plans.scoring import score_events
from groundtrace.sources.events import read_event_stream, split_corrupt


def _keyed(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Raw events with an event_key, from their content where they bring none."""
    return with_content_key(raw) if "event_key" in keep and "event_key" not in raw.columns else raw


def score_stream(raw: DataFrame, model: ForestModel, keep: tuple[str, ...] = ("event_key",),
                 contributions: bool = True) -> DataFrame:
    """Raw events (stream or table) to verdict, confidence and drivers."""
    return score_events(prepare_events(_keyed(raw, keep), keep), model, keep, contributions)


def heuristic_stream(raw: DataFrame, keep: tuple[str, ...] = ("event_key",)) -> DataFrame:
    """Raw events to the rule-based verdict."""
    return heuristic_verdict(prepare_events(_keyed(raw, keep), keep)).select(
        *keep, "heuristic_score", "heuristic_verdict", "heuristic_reasons")


def write_scores(scores: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append scores as parquet; ``once`` drains what is there and stops."""
    writer = scores.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def write_scored_batches(raw: DataFrame, path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame],
                         once: bool = True) -> StreamingQuery:
    """Score every micro-batch as a table and write it below ``path/scores`` under its number; ``read_batches`` reads it.

    A micro-batch is a table whose rows can be counted, so its features take the form that suits it. A batch that was
    cut short is run again under its number and replaces what it finds.
    """

    def save(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/scores/batch={number}")

    writer = raw.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


BAD_LINE = "_bad_line"


def score_json_stream(spark: SparkSession, source: str, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame],
                      files_per_trigger: int | None = None, extra: dict[str, str] | None = None, once: bool = True) -> StreamingQuery:
    """JSON lines of a growing folder to two sinks below ``out``: ``scores`` and ``bad_lines``.

    ``score`` maps raw events to result rows, for example ``heuristic_stream``. Each micro-batch writes both sinks
    under its number and replaces what it finds there. A batch that was cut short is run again with the same files and
    the same number, so a restart neither repeats nor loses a row.
    """
    raw = read_event_stream(spark, source, True, files_per_trigger, "PERMISSIVE", BAD_LINE, extra)

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()  # both sinks read it
        try:
            events, bad = split_corrupt(batch, BAD_LINE)
            score(events).write.mode("overwrite").parquet(f"{out}/scores/batch={number}")
            bad.write.mode("overwrite").parquet(f"{out}/bad_lines/batch={number}")
        finally:
            batch.unpersist()

    writer = raw.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_batches(spark: SparkSession, out: str, sink: str) -> DataFrame:
    """All rows of a sink of ``score_json_stream``, with the number of their ``batch``."""
    return spark.read.option("basePath", f"{out}/{sink}").parquet(f"{out}/{sink}/batch=*")


def single_event_timings(spark: SparkSession, events: DataFrame, folder: str, score: Callable[[DataFrame], DataFrame],
                         count: int = 10) -> DataFrame:
    """(stage, rows, ms) of ``count`` triggers of one event each, as the stream's own progress reports them.

    The first event pays for planning and code generation, as it does in service.
    """
    lines = events.limit(count).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns])).alias("value"))
    lines.repartition(count, F.monotonically_increasing_id()).write.option("maxRecordsPerFile", 1).text(f"{folder}/events")
    schema = events.schema
    raw = spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).json(f"{folder}/events")
    running = score(raw).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start(f"{folder}/scores")
    running.awaitTermination()
    rows = [("single_event", int(p["numInputRows"]), float(p["durationMs"]["triggerExecution"]))
            for p in running.recentProgress if p["numInputRows"]]
    return spark.createDataFrame(rows, "stage string, rows long, ms double")
