"""Stateful streams: dynamic sampling, warning counters and idle heartbeats.

Each keeps a small state per key in ``transformWithStateInPandas``; their batch twins
are ``operators.sampling`` and ``operators.logs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.logs import MISSING, SEVERE, SUMMARY_EVERY, SUMMARY_FIRST, SUMMARY_SEVERE
from ..operators.sampling import keep_frame

#: The state store that several state variables need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _portable() -> None:
    """Lets the processors travel by value: the driver's own Python worker has no access to shipped packages."""
    import sys

    from pyspark import cloudpickle

    from ..operators import sampling

    for module in (sys.modules[__name__], sampling):
        cloudpickle.register_pickle_by_value(module)


class FrameSampler(StatefulProcessor):
    """Keeps a frame if it is the first, far enough from the last kept one, or unlike it."""

    def __init__(self, video: str, index: str, bits: str, max_gap: str, skip: float, columns: list[str]):
        self.video, self.index, self.bits, self.max_gap, self.skip, self.columns = video, index, bits, max_gap, skip, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint, bits bigint, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        x = pd.concat(list(rows)).sort_values([self.index, self.bits], kind="stable")
        at, bits, seen = (int(v) for v in self.last.get()) if self.last.exists() else (None, None, None)
        state = None if at is None else (at, bits)
        if seen is not None and len(x) and int(x[self.index].iloc[0]) < seen:
            raise ValueError(f"frame {int(x[self.index].iloc[0])} of {key[0]} came after frame {seen}")
        kept = []
        for at, bits, gap in zip(x[self.index], x[self.bits], x[self.max_gap]):
            keep = keep_frame(state, int(at), int(bits), max(1, int(gap)), self.skip)
            if keep:
                state = (int(at), int(bits))
            kept.append(keep)
        if state is not None:
            self.last.update((*state, int(x[self.index].iloc[-1])))
        yield x[kept][self.columns]

    def close(self) -> None:
        pass


def sample_stream(frames: DataFrame, video: str, index: str, bits: str, max_gap: str, skip: float = 0.90) -> DataFrame:
    """The kept rows of a stream of frames.

    The frames of a video must arrive in order of their index, batch by batch; one that comes in a later batch than a
    frame after it is an error, never a silent loss. Within a batch they are sorted, in the memory of a task: limit the
    batches of the source where a video has very many new frames at once.
    """
    _portable()
    rows = frames.where(f"{video} is not null and {index} is not null and {bits} is not null")
    return rows.groupBy(video).transformWithStateInPandas(FrameSampler(video, index, bits, max_gap, skip, rows.columns), rows.schema, "Append", "None")


class WarningCounter(StatefulProcessor):
    """Counts decoder warnings of the current context of a stream and reports running totals."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "context string, nal bigint, missing bigint, other bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        x = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        context, nal, missing, other = self.state.get() if self.state.exists() else (None, 0, 0, 0)
        out = []
        for marker, line in zip(x["marker"], x["line"]):
            if isinstance(marker, str):
                if nal + missing + other and _unreported(nal, missing, other):
                    out.append((key[0], context, "final", nal, missing, other))
                context, nal, missing, other = marker, 0, 0, 0
                continue
            if SEVERE[0] in line:
                nal += 1
            elif MISSING in line:
                missing += 1
            else:
                other += 1
            total = nal + missing + other
            if total == SUMMARY_FIRST or total % SUMMARY_EVERY == 0:
                out.append((key[0], context, "running", nal, missing, other))
        self.state.update((context, nal, missing, other))
        yield pd.DataFrame(out, columns=["stream", "context", "kind", "invalid_nal", "missing_picture", "other"])

    def close(self) -> None:
        pass


def _unreported(nal: int, missing: int, other: int) -> bool:
    total = nal + missing + other
    return not (total == SUMMARY_FIRST or total % SUMMARY_EVERY == 0) and (total >= SUMMARY_FIRST or nal + other >= SUMMARY_SEVERE)


def warning_stream(lines: DataFrame, kind: str = "bigint") -> DataFrame:
    """Summaries of a stream of log lines: ``stream``, ``line_no``, ``marker`` (context, null for a warning line), ``line``."""
    _portable()
    schema = f"stream {kind}, context string, kind string, invalid_nal bigint, missing_picture bigint, other bigint"
    return lines.groupBy("stream").transformWithStateInPandas(WarningCounter(), schema, "Append", "None")


class Heartbeat(StatefulProcessor):
    """Emits a row when a key has been silent for a while, and again as long as the silence lasts."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "rows bigint, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        n = sum(len(x) for x in rows)
        now = timerValues.getCurrentProcessingTimeInMs()
        before = self.seen.get()[0] if self.seen.exists() else 0
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(now + self.idle_ms)
        self.seen.update((before + n, now))
        yield pd.DataFrame({"stream": pd.Series([], dtype="object"), "rows": pd.Series([], dtype="int64"), "idle_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        rows, at = self.seen.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.idle_ms)
        yield pd.DataFrame({"stream": [str(key[0])], "rows": [rows], "idle_ms": [now - at]})

    def close(self) -> None:
        pass


def heartbeat_stream(lines: DataFrame, stream: str = "stream", idle_ms: int = 15_000) -> DataFrame:
    """``stream``, ``rows`` so far, ``idle_ms`` whenever a stream was silent for ``idle_ms``."""
    _portable()
    return lines.groupBy(stream).transformWithStateInPandas(Heartbeat(idle_ms), "stream string, rows bigint, idle_ms bigint", "Append", "ProcessingTime")
