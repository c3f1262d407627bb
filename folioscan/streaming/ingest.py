"""Documents as a stream: files that arrive are read, cut, embedded and stored batch by batch."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..plans.engine import Engine
from ..sources.readers import with_ids
from ..sources.store import Store

SCHEMA = "text string, title string, year int, source_name string"


def stream_documents(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of JSON lines that arrive as files under path."""
    return with_ids(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(path))


def ingest(docs: DataFrame, engine: Engine, checkpoint: str, progress=None) -> StreamingQuery:
    """Index what a stream brings, once each: known fingerprints are skipped, so a repeated batch adds nothing.

    progress(batch id, counts) is called after each batch.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            counts = engine.add(batch)
            if progress:
                progress(batch_id, counts)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressLog(StreamingQueryListener):
    """Appends what streams report to `path` as lines of JSON, which readers.read_events() reads.

    A micro-batch is a `stage` line, a query's end a `result`, or an `error` with its reason.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _line(self, **fields) -> None:
        self.spark.createDataFrame([(json.dumps(fields, default=str),)], "value string").coalesce(1).write.mode("append").text(self.path)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._line(type="stage", query=event.id, name=event.name, stage="started", at=event.timestamp)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        states = sum(s.numRowsTotal for s in p.stateOperators)
        self._line(type="stage", query=p.id, name=p.name, stage="batch", batch=p.batchId, rows=p.numInputRows, states=states, ms=dict(p.durationMs), at=p.timestamp)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self._line(type="error", query=event.id, error=str(event.exception)[:500])
        else:
            self._line(type="result", query=event.id, ended=True)


def sweep(spark: SparkSession, store: Store, checkpoint: str, every: str = "1 minute", done=None) -> StreamingQuery:
    """Purge expired documents again and again; done(batch id, how many) is called after each round. stop() ends it."""

    def one(_: DataFrame, batch_id: int) -> None:
        gone = store.purge(datetime.datetime.now()) if store.table("documents") is not None else 0
        if done:
            done(batch_id, gone)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
