"""Streaming forms: files arriving week by week, and the automaton over frames as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldlens.operators.automaton import usable


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], partition: str) -> None:
    """Process the files under ``source`` that the checkpoint hasn't seen, once, into Parquet by ``partition``
    (STR-1). A second call with nothing new does nothing; a batch that was begun and lost is written again whole,
    since each batch has a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").partitionBy(partition).parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _advanced(rows: pd.DataFrame, frame: str, p: str, threshold: float, run: int, state: tuple) -> tuple[tuple, list[tuple[int, str]]]:
    """State after the rows of a key, (kind, length, whether an opportunity is open, last frame), and the (frame, event) they bring."""
    high, length, opened, last = state
    rows = rows.groupby(frame, as_index=False)[p].max()
    fresh = rows[frame] > last if last is not None else np.ones(len(rows), bool)
    out = [(int(f), "late") for f in rows[frame][~fresh]]
    at, above = rows[frame][fresh].to_numpy(np.int64), rows[p][fresh].to_numpy() > threshold
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(above.astype(int)) != 0)])) if len(at) else np.zeros(0, int)
    for lo, hi in zip(starts, np.append(starts[1:], len(at)), strict=True):  # runs, not frames
        if last is not None and at[lo] != last + 1:
            opened, length = False, 0
        carried = length if bool(above[lo]) == high else 0
        high, length, last = bool(above[lo]), carried + int(hi - lo), int(at[hi - 1])
        if carried < run <= length and high != opened:
            opened = high
            out.append((int(at[lo]) + run - carried - 1, "open" if high else "miss"))
    return (high, length, opened, last), out


def opportunity_events(frames: DataFrame, key: str, frame: str, p: str, threshold: float = 0.75, run: int = 5) -> DataFrame:
    """``key, frame, event`` of a stream of scored frames (STR-2): ``open`` and ``miss`` as in
    automaton.opportunities(), and ``late`` for a frame that isn't after the last one seen, which is not used.

    The state of a key is that of its current run of equal kind: the kind, its length, whether an opportunity is open,
    and the last frame. Keys are kept for ever; timed_opportunity_events() forgets those that have ended.
    """
    kind = dict(frames.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = _advanced(pd.concat(list(batches)), frame, p, threshold, run, state.get if state.exists else (False, 0, False, None))
        state.update(now)
        yield pd.DataFrame([(k[0], *e) for e in out], columns=[key, frame, "event"])

    return usable(frames, frame, p).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {frame} long, event string", "high boolean, length int, opened boolean, last long", "append", GroupStateTimeout.NoTimeout
    )


def timed_opportunity_events(frames: DataFrame, key: str, frame: str, p: str, time: str, delay: str, idle_ms: int, threshold: float = 0.75, run: int = 5) -> DataFrame:
    """opportunity_events() of frames that carry their ``time``: rows more than ``delay`` behind the latest time are dropped by the watermark, and a key without rows for
    ``idle_ms`` of event time ends: its last frame comes out as ``end`` and its state is forgotten (STR-2).

    Time is that of the rows alone, so a stream that is run again over the same files forgets at the same places, and one that runs until it has read what there is
    (availableNow) ends. A key that comes back after its end starts anew. Keep the state in RocksDB where keys are many:
    ``spark.sql.streaming.stateStore.providerClass``.
    """
    kind = dict(frames.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            *_, last, _ = state.get
            state.remove()
            yield pd.DataFrame([(k[0], last, "end")], columns=[key, frame, "event"])
            return
        rows = pd.concat(list(batches))
        *before, seen = state.get if state.exists else (False, 0, False, None, 0)
        now, out = _advanced(rows, frame, p, threshold, run, tuple(before))
        seen = max(seen, int(rows[time].max().timestamp() * 1000))
        state.update((*now, seen))
        state.setTimeoutTimestamp(max(seen + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], *e) for e in out], columns=[key, frame, "event"])

    timed = usable(frames, frame, p).where(F.col(time).isNotNull()).withWatermark(time, delay)
    return timed.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {frame} long, event string", "high boolean, length int, opened boolean, last long, seen long", "append", GroupStateTimeout.EventTimeTimeout
    )
