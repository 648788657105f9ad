"""The job queue as a stateful stream: one state for each job, fed by events, equal to the batch fold."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry._session import workers_see_package
from quarry.operators.jobs import START, fold

OUT = "job_id long, status string, attempt int, next_at double, version long"
STATE = "status string, attempt int, next_at double, version long"


class JobProcessor(StatefulProcessor):
    """Applies a job's events in the order of (seconds, event_id) and gives its new state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        status, attempt, at, version = self.state.get() if self.state.exists() else (*START, 0)
        events = pd.concat(list(rows)).sort_values(["seconds", "event_id"])
        status, attempt, at = fold(zip(events["event"], events["seconds"], strict=True), (status, attempt, at))
        version += len(events)
        self.state.update((status, attempt, at, version))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempt": [attempt], "next_at": [at], "version": [version]})

    def close(self) -> None:
        pass


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="quarry-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def stream_states(events: DataFrame) -> DataFrame:
    """A streaming frame of job events (job_id, event_id, event, seconds) to one of state versions.

    Events of a later micro-batch count as later; within one they go by (seconds, event_id).
    """
    workers_see_package(events.sparkSession)
    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobProcessor(), outputStructType=OUT, outputMode="Append", timeMode="None")


def states_by_stream(events: DataFrame, files: int = 1) -> DataFrame:
    """Last states of a log that is written out, read as a stream with ``availableNow`` and folded by job."""
    spark = events.sparkSession
    folder = shared_folder(spark)
    events.where("job_id is not null").repartitionByRange(files, "seconds", "event_id").write.parquet(f"{folder}/events")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        run = stream_states(source).writeStream.format("parquet").option("path", f"{folder}/states").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if before is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = F.max(F.struct("version", "status", "attempt", "next_at")).alias("s")
    return spark.read.parquet(f"{folder}/states").groupBy("job_id").agg(last).select("job_id", "s.status", "s.attempt", "s.next_at")
