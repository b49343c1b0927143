"""Scoring a stream of rows with a saved or fitted run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabforge.plans.training import Run


def score_stream(run: Run, stream: DataFrame) -> DataFrame:
    """Features and the best model's scores for a stream; only row-wise steps are allowed.

    Lagged columns look at other rows, which a stream cannot offer, so plans
    holding any are refused up front.
    """
    if not stream.isStreaming:
        raise ValueError("not a stream")
    lagged = [c for c in stream.columns + run.plan.parts["base"] if "[-" in c]
    if lagged:
        raise ValueError(f"lagged features cannot be made on a stream: {lagged[:3]}")
    if run.plan.parts["vectors"]:
        raise ValueError("text vectors regroup rows, which a stream cannot offer: use write_batches")
    key = run.spec["key"]
    model = next((m for m in run.models if m.algo == run.best), run.models[0])
    return model.scores(run.plan.transform(stream), key).withColumn("scored_at", F.current_timestamp())


def write_scores(scores: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append scores to a Parquet folder, exactly once per input row."""
    writer = scores.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_batches(run: Run, stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Score a stream batch by batch, with any features of single rows; a batch that runs again replaces its own folder."""
    def score(batch: DataFrame, number: int) -> None:
        run.score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
