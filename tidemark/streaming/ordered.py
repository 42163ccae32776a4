"""Kernels in a stream whose rows come in any order within the watermark.

Rows wait in their series' state until the watermark has passed them, and then run
through the kernel in order of time, so that the result doesn't depend on how the
stream was cut into micro-batches or in which order files were found. What is
later than the watermark is dropped, as by any stateful operator. The state holds
the kernel and the waiting rows, in columns: as many as come within the watermark's
delay, and within the micro-batch that moves it. A kernel that is only asked at the
ends of steps needs no more than ``step_ends`` leaves of them, however many rows a
step has.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType, _parse_datatype_string

from ..functions.scalars import place
from ..operators.scan import Kernel

#: The series of closing rows, whose only purpose is to move the watermark past all others.
CLOSING = ""
#: Rows that a task turns to Python values at once.
SLICE = 10_000


def step_ends(df: DataFrame, late: str, step_ms: int) -> DataFrame:
    """Of each symbol's rows of a kind in a step, the first known value and that of the last millisecond, once the watermark has passed the step: of a millisecond's rows the known value of the largest ``seq``. The whole milliseconds that divide by ``step_ms`` are the last of their steps. ``df``: symbol, kind, side, asks, ts, ms, seq and value."""
    at, known = F.timestamp_millis("ms"), F.col("value").isNotNull()
    first = F.when(known, place(at, F.bitwise_not("seq")))  # the largest seq before the others
    last = place(at, F.when(known, F.col("seq")))
    step = F.window("ts", f"{step_ms} milliseconds", startTime="1 millisecond").alias("step")
    steps = df.withWatermark("ts", late).groupBy("symbol", "kind", "side", "asks", step).agg(F.min(F.when(known, F.col("ms"))).alias("from"), F.min_by("value", first).alias("first"), F.max("ms").alias("to"), F.max_by("value", last).alias("last"))
    end = lambda ms, value: F.struct(F.col(ms).alias("ms"), F.col(value).alias("value"))
    ends = F.when(F.col("from") < F.col("to"), F.array(end("from", "first"), end("to", "last"))).otherwise(F.array(end("to", "last")))
    return steps.select("symbol", "kind", "side", "asks", F.inline(ends)).select("symbol", F.timestamp_millis("ms").alias("ts"), "side", "kind", "asks", "ms", "value")


def in_order(df: DataFrame, kernel: Callable[[], Kernel], late: str, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts", "side", "seq"), only: str | None = None) -> DataFrame:
    """All columns of a stream and those that the kernel makes, a row per row (where column ``only`` is true, if named; the others still run through the kernel). ``order`` may be in whole milliseconds: one's rows run together, once the watermark has passed all of it."""
    sample = kernel()
    made = [StructField(n, _parse_datatype_string(t)) for n, t in sample.makes]
    schema = StructType([*df.schema.fields, *made])
    names = [f.name for f in df.schema.fields]
    reads = [names.index(c) for c in sample.reads]
    shown = names.index(only) if only else None
    whole = {f.name: "Int64" for f in df.schema.fields if isinstance(f.dataType, IntegralType)}

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own, waiting = pickle.loads(state.get[0]) if state.exists else (kernel(), None)
        frames = [] if waiting is None else [waiting]
        if not state.hasTimedOut:
            frames.extend(batch.astype(whole) for batch in batches)
        rows = pd.concat(frames, ignore_index=True)
        del frames, waiting
        ripe = rows["ts"] < pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        waiting = None if ripe.all() else rows[~ripe]
        rows = rows[ripe].sort_values(list(order), kind="stable", na_position="first")
        for begin in range(0, len(rows), SLICE):
            part = rows.iloc[begin : begin + SLICE]
            out = []
            for r in zip(*(part[c].astype(object).where(part[c].notna(), None) for c in names), strict=True):
                values = own.step(*(r[i] for i in reads))
                if shown is None or r[shown]:
                    out.append((*r, *values))
            yield pd.DataFrame(out, columns=[*names, *sample_names], dtype=object)
        state.update((pickle.dumps((own, waiting)),))
        if waiting is not None:
            state.setTimeoutTimestamp(int(waiting["ts"].min().timestamp() * 1000) + 1)

    sample_names = [f.name for f in made]
    marked = df.withWatermark("ts", late).groupBy(*keys)
    return marked.applyInPandasWithState(update, schema, "kernel binary", "append", "EventTimeTimeout").where(F.col(keys[0]) != CLOSING)


def closing_row(rows: DataFrame, delay_ms: int) -> DataFrame:
    """A row of no series, so long after the last that the watermark passes all others."""
    nulls = [F.lit(CLOSING).alias("symbol") if f.name == "symbol" else F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    last = rows.agg(F.timestamp_millis(F.unix_millis(F.max("ts")) + delay_ms).alias("ts")).where("ts is not null")
    return last.select(*nulls)


class Components(Kernel):
    """What all streams said last, for each grid row: price some time before (that of the first millisecond with any if it is unknown), open interest's change over a window, funding rate and depth imbalance. Holds the prices and prints of its windows."""

    reads = ("kind", "ms", "value")
    makes = (("old_price", "double"), ("oi_pct", "double"), ("funding_rate", "double"), ("imbalance", "double"))

    def __init__(self, price_back: int, oi_window: int):
        self.price_back, self.oi_window = price_back, oi_window
        self.first_price, self.first_ms, self.prices = None, None, deque()
        self.oi, self.first_oi, self.last_two = deque(), None, deque(maxlen=2)
        self.rate = self.imbalance = None

    def step(self, kind, ms, value):
        if kind == "price":
            if value is not None and self.first_ms in (None, ms):
                self.first_price, self.first_ms = value, ms
            self.prices.append((ms, value))
        elif kind == "oi":
            if not self.last_two:
                self.first_oi = value
            self.oi.append((ms, value))
            self.last_two.append(value)
        elif kind == "funding":
            self.rate = value
        elif kind == "book":
            self.imbalance = value
        elif kind == "grid":
            return self.told(ms)
        return (None,) * 4

    def told(self, ms):
        while len(self.prices) > 1 and self.prices[1][0] <= ms - self.price_back:
            self.prices.popleft()
        while self.oi and self.oi[0][0] < ms - self.oi_window:
            self.oi.popleft()
        old = self.prices[0][1] if self.prices and self.prices[0][0] <= ms - self.price_back else None
        if len(self.last_two) < 2:
            base = None
        else:
            base = self.last_two[0] if len(self.oi) < 2 else self.first_oi if self.oi[0][1] is None else self.oi[0][1]
        now = self.last_two[-1] if self.last_two else None
        change = (now - base) / base * 100 if now is not None and base is not None and base > 0 else None
        return self.first_price if old is None else old, change, self.rate, self.imbalance
