"""Scoring of arriving readings, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from hourloom.plans.anomaly import AnomalyModel, score_readings


def score_stream(
    readings: DataFrame, model: AnomalyModel, output: str, checkpoint: str, history: DataFrame | None = None
) -> StreamingQuery:
    """Score each micro-batch of posted readings with the batch operator.

    Row windows need the rows of their series, which streaming operators cannot
    provide; each micro-batch is therefore one batch job over its own readings
    plus ``history``.  The batch number names the output folder, so a batch that
    is repeated after a failure replaces its own result.
    """

    def write(batch: DataFrame, number: int) -> None:
        scores, rejects = score_readings(model, batch, history)
        scores.write.mode("overwrite").parquet(f"{output}/scores/batch={number}")
        rejects.write.mode("overwrite").parquet(f"{output}/rejects/batch={number}")

    return (
        readings.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
