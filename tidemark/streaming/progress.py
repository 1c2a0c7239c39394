"""Progress of running queries as rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SAMPLE_DDL = (
    "sample_index BIGINT, batch_id BIGINT, captured_at STRING, input_rows BIGINT, "
    "rows_per_second DOUBLE, duration_ms BIGINT, state_rows BIGINT, error STRING"
)


def _sample(index: int, progress: dict) -> tuple:
    try:
        return (
            index,
            progress["batchId"],
            progress["timestamp"],
            progress.get("numInputRows", 0),
            progress.get("processedRowsPerSecond"),
            progress.get("durationMs", {}).get("triggerExecution"),
            sum(s.get("numRowsTotal", 0) for s in progress.get("stateOperators", [])),
            None,
        )
    except (KeyError, TypeError) as error:
        # an unreadable sample stays visible as an error instead of reading as zero
        return (index, None, None, None, None, None, None, f"{type(error).__name__}: {error}")


def progress_samples(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The progress reports Spark keeps of a query (a bounded number), one row each."""
    rows = [
        _sample(i, p if isinstance(p, dict) else json.loads(p.json))
        for i, p in enumerate(query.recentProgress)
    ]
    return spark.createDataFrame(rows, SAMPLE_DDL)


class ProgressSampler(StreamingQueryListener):
    """Appends each progress report of all queries of the session to a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.seen = spark, path, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = _sample(self.seen, json.loads(event.progress.json))
        self.seen += 1
        self.spark.createDataFrame([row], SAMPLE_DDL).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
