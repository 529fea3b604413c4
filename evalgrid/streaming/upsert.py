"""An extension: leaderboard rows from a stream, merged batch by batch."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evalgrid.operators.aggregate import KEYS
from evalgrid.sources.sinks import upsert_csv


def stream_to_leaderboard(rows: DataFrame, csv: str | Path, checkpoint: str, keys: tuple[str, ...] = KEYS) -> StreamingQuery:
    """Each micro-batch is an upsert by key, so a batch that runs twice changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert_csv(batch.sparkSession, batch, csv, keys)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
