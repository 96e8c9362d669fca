"""Keyed folds on streams: small step functions run by one stateful processor.

The state of a key is one JSON text in the state store, so it survives the loss of an
executor with the store's checkpoint. A micro-batch is sorted per key before the steps run;
its size is bounded by the source's trigger limits (``live.in_order`` lands a table in such pieces).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Step = Callable[[dict, dict], tuple[dict, Sequence[tuple]]]
#: Rows that are taken out of Arrow, and given back, at a time.
SLICE = 20_000
#: Rows that a step which looks ahead is told of at a time.
AHEAD = 64
#: When a state changes by itself (seconds, or None), and what it then becomes and emits.
Timers = tuple[Callable[[dict], float | None], Callable[[dict, float], tuple[dict, Sequence[tuple]]]]


class Fold(StatefulProcessor):
    """Runs ``step`` over the rows of a key, those of a micro-batch in the order of ``order``.

    No row is lost: one that comes in a later batch than its place is folded when it arrives, so
    a source that delivers in order gives the same rows however it is cut into batches. With
    ``drop_late`` such rows are skipped instead."""

    def __init__(self, step: Step, start: dict, order: Sequence[str], columns: Sequence[str], keys: Sequence[str], drop_late: bool = False, timers: Timers | None = None):
        self.step, self.start, self.order, self.columns, self.keys = step, start, list(order), list(columns), list(keys)
        self.drop_late, self.timers = drop_late, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "body string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        body = json.loads(held[0]) if held else {"s": self.start, "at": None}
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        ahead = None if self.drop_late else getattr(self.step, "ahead", None)
        for lo in range(0, len(batch), SLICE):
            out: list[tuple] = []
            records = batch.iloc[lo:lo + SLICE].to_dict("records")
            for i, r in enumerate(records):
                if ahead and i % AHEAD == 0:
                    body["s"] = ahead(body["s"], records[i:i + AHEAD])
                at = [_plain(r[c]) for c in self.order]
                if self.drop_late and body["at"] is not None and at <= body["at"]:
                    continue
                body["s"], emitted = self.step(body["s"], r)
                body["at"] = at
                out.extend(emitted)
            if out:
                yield self.frame(key, out)
        self.store(body)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The watermark has passed what a quiet key waits for."""
        body = json.loads(self.state.get()[0])
        body.pop("timer", None)
        body["s"], out = self.timers[1](body["s"], expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self.store(body)
        yield self.frame(key, out)

    def store(self, body: dict) -> None:
        """Keeps the state, and one timer for the next time at which it would change by itself."""
        if self.timers:
            due = self.timers[0](body["s"])
            timer = None if due is None else int(due * 1000) + 1
            if timer != body.get("timer"):
                if body.get("timer") is not None:
                    self.handle.deleteTimer(body["timer"])
                if timer is not None:
                    self.handle.registerTimer(timer)
                body["timer"] = timer
        self.state.update((json.dumps(body),))

    def frame(self, key: Any, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=self.columns)
        for k, v in zip(self.keys, key):
            frame[k] = v
        return frame

    def close(self) -> None:
        pass


def _plain(v: Any) -> Any:
    return v.value if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v


def keyed_fold(stream: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, start: dict, schema: str, timers: Timers | None = None) -> DataFrame:
    """Fold a stream (or a batch frame) per key. ``schema`` lists the emitted columns, keys last.

    With ``timers`` the stream must have a watermark: states then also change when it passes, without rows of their key.
    """
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    emitted = [c for c in columns if c not in keys]
    fold = Fold(step, start, order, emitted, keys, timers=timers)
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=fold, outputStructType=schema, outputMode="Append", timeMode="EventTime" if timers else "None")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed folds need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
