"""Streams over files: pair processing that resumes, routed logs, progress metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import logs, tasks


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **options: str) -> StreamingQuery:
    """Runs a stream over everything that is there and ends; a later call goes on where this one committed."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def process_new_pairs(pairs: DataFrame, compare: Callable[[DataFrame], DataFrame], store: str, signature: str, checkpoint: str) -> StreamingQuery:
    """Compares the pairs of a stream that the store doesn't hold yet and appends the results.

    ``pairs`` has ``pair_key``, which changes with the files of the pair, so a changed file makes only its own pairs
    pending. A batch that is run again after a failure writes the same version, and the latest version counts.
    """
    spark = pairs.sparkSession

    def batch(df: DataFrame, epoch: int) -> None:
        have = _read(spark, store)
        todo = df.dropDuplicates(["pair_key"])
        if have is not None:
            todo = tasks.pending_pairs(todo, have, signature)
        done = compare(todo)
        done.withColumn("signature", F.lit(signature)).withColumn("version", F.lit(epoch).cast("long")).write.mode("append").parquet(store)

    return run_available(pairs, batch, checkpoint)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) and len(fs.listStatus(p)) else None


def route_lines(lines: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Log lines written by route (context, warning, quarantine, progress, hidden, log), each its own partition."""
    routed = lines.withColumn("route", logs.route("line"))
    return run_available(routed, lambda df, epoch: df.write.mode("append").partitionBy("route").parquet(sink), checkpoint)


class ProgressListener(StreamingQueryListener):
    """Collects what queries report; ``lines`` holds progress lines in the pipe form."""

    def __init__(self) -> None:
        self.lines: list[str] = []

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.lines.append(f"PROGRESS|scan|0|1|{event.id}")

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.lines.append(f"PROGRESS|compare|{event.progress.batchId + 1}|{event.progress.batchId + 1}|{event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.lines.append(f"PROGRESS|done|1|1|{event.id}")


def cancel(spark: SparkSession, group: str) -> None:
    """Stops the jobs of a group and the streams of the session."""
    spark.sparkContext.cancelJobGroup(group)
    for q in spark.streams.active:
        q.stop()
