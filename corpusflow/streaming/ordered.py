"""Event-time ordered state: rows are decided in order, once the watermark has passed them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

AT = "at_us"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME_ROWS = 10_000
#: Groups that keys are dealt to by hash; the states of a group are read and written at once.
BUCKETS = 256


def use_ordered_state(spark) -> None:
    """Structured state needs the RocksDB store; set before a query starts."""
    spark.conf.set(PROVIDER, ROCKSDB)


def _plain(value: Any) -> Any:
    return None if value is pd.NaT or value != value else value


class OrderedState(StatefulProcessor):
    """Folds the rows that the watermark has passed, each key in order.

    A batch brings rows later than all of the batches before. ``step(state, row)`` returns the new state and an
    output tuple or None. The states of the keys of a bucket are one value; with ``idle_ms``, keys are forgotten
    at the end of their idle time, by one timer per bucket."""

    def __init__(self, keys: list[str], order: list[str], key_schema: str, state_schema: str, start: Callable[[], tuple],
                 step: Callable[[tuple, Any], tuple[tuple, tuple | None]], made: list[str], idle_ms: int | None) -> None:
        self.keys, self.order, self.schema = keys, [AT, *order], f"held array<struct<{key_schema}, {state_schema}, last_us bigint>>, timer_ms bigint"
        self.begin, self.step, self.made, self.idle_ms = start, step, made, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def _read(self) -> tuple[dict[tuple, tuple], int]:
        """State and last time by key, and the time of the timer."""
        if not self.value.exists():
            return {}, 0
        held, timer = self.value.get()
        n = len(self.keys)
        return {tuple(x[:n]): tuple(x[n:]) for x in held}, timer

    def _write(self, held: dict[tuple, tuple], timer: int, passed_ms: int) -> None:
        if self.idle_ms is not None:
            # a row that comes after this is later than the watermark, so it begins anew
            held = {k: v for k, v in held.items() if v[-1] + self.idle_ms * 1000 > passed_ms * 1000}
            wake = max(passed_ms + 1, min(v[-1] for v in held.values()) // 1000 + self.idle_ms + 1) if held else 0
            if timer > passed_ms and timer != wake:
                self.handle.deleteTimer(timer)
            if wake and timer != wake:
                self.handle.registerTimer(wake)
            timer = wake
        if held:
            self.value.update(([(*k, *v) for k, v in held.items()], timer))
        else:
            self.value.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.sort_values(self.order)
        held, timer = self._read()
        out = []
        for lo in range(0, len(frame), FRAME_ROWS):
            part = frame.iloc[lo:lo + FRAME_ROWS]
            names = zip(*(part[k].tolist() for k in self.keys))
            for name, copies, row in zip(names, part["copies"].tolist(), part.itertuples(index=False)):
                name, now = tuple(map(_plain, name)), getattr(row, AT)
                *state, last = held.get(name) or (*self.begin(), now)
                if self.idle_ms is not None and now - last > self.idle_ms * 1000:
                    state = self.begin()
                for _ in range(copies):
                    state, made = self.step(tuple(state), row)
                    if made is not None:
                        out.append((*name, *made))
                held[name] = (*state, now)
            yield pd.DataFrame(out, columns=self.made)
            out = []
        self._write(held, timer, timerValues.getCurrentWatermarkInMs() if self.idle_ms is not None else 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._read()
        if expiredTimerInfo.getExpiryTimeInMs() == timer:
            self._write(held, timer, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(columns=self.made)

    def close(self) -> None:
        pass


def ordered_stream(stream: DataFrame, keys: list[str], columns: list[str], order: list[str], state_schema: str, start: Callable[[], tuple],
                   step: Callable[[tuple, Any], tuple[tuple, tuple | None]], made: str, ts: str = "ts", delay: str = "1 hour",
                   idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Outputs of ``step`` over each key in order of ``ts`` and ``order``, in append mode.

    Rows wait, counted by a streaming aggregation, until the watermark, ``delay`` behind the latest time seen, reaches
    them; later ones are dropped. A key without rows for ``idle_ms`` of event time is forgotten. ``made`` is the schema
    of what ``step`` returns, behind the keys; rows hold ``columns`` and the time in microseconds as ``at_us``. What
    waits is held by the state store; what falls due at once of a key, as columns, by one task. ``buckets`` should
    grow with the keys of a long-lived stream, as the states of a bucket are written together."""
    ready = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, delay).select(ts, *keys, *columns)
    passed = ready.groupBy(ts, *keys, *columns).agg(F.count(F.lit(1)).alias("copies"))
    return fold_passed(passed, keys, columns, order, state_schema, start, step, made, ts, idle_ms, buckets)


def fold_passed(passed: DataFrame, keys: list[str], columns: list[str], order: list[str], state_schema: str, start: Callable[[], tuple],
                step: Callable[[tuple, Any], tuple[tuple, tuple | None]], made: str, ts: str = "ts", idle_ms: int | None = None,
                buckets: int = BUCKETS) -> DataFrame:
    """``step`` over rows that the watermark has passed, with their number as ``copies``."""
    dealt = passed.select(ts, F.unix_micros(ts).alias(AT), *keys, *columns, "copies", F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    key_schema = ", ".join(f"{c} {kinds[c]}" for c in keys)
    output = f"{key_schema}, {made}"
    made_names = [p.strip().split(" ")[0] for p in output.split(",")]
    processor = OrderedState(keys, order, key_schema, state_schema, start, step, made_names, idle_ms)
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, output, "append", "none" if idle_ms is None else "eventTime")
