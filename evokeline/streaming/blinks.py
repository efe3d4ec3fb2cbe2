"""Blinks in a stream, by the rule of the batch operator: local maxima over a threshold, those close to one before them being one blink.

Rows wait in a subject's state until the watermark has passed them, so micro-batches may bring them in any order; then they
go in the order of their samples through what the subject has behind it: the last two samples, the blink that is open, and the
closed ones that wait for the least count. A blink closes when a later row is further than the refractory gap from its last
peak. A timer brings a subject on when the watermark moves and no row of its own comes. Rows at or before the watermark that
was processed are late and go. What a state holds is bounded by the watermark's delay and the least count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Blinks:
    """A subject's past, as far as blinks to come need it."""

    def __init__(self, text: str | None = None):
        kept = json.loads(text) if text else {}
        self.waiting: list[tuple[int, int, float | None]] = [tuple(x) for x in kept.get("waiting", [])]  # (time in ms, sample, x)
        self.seen: int = kept.get("seen", -(1 << 62))  # the watermark up to which rows were taken
        self.before, self.last = kept.get("before"), kept.get("last")  # the last two rows (sample, x)
        self.open, self.peak = kept.get("open"), kept.get("peak")  # the highest (sample, x) of the open blink, and its last peak's sample
        self.number, self.held = kept.get("number", 0), kept.get("held", [])

    def text(self) -> str:
        return json.dumps(self.__dict__)

    def passed(self, watermark: int, threshold: float, refractory: int) -> list[list]:
        """Take the rows up to the watermark; gives the blinks that close, as (number, sample, peak)."""
        ready = sorted((x for x in self.waiting if x[0] <= watermark), key=lambda x: (x[1], x[0]))
        self.waiting = [x for x in self.waiting if x[0] > watermark]
        self.seen, closed = max(self.seen, watermark), []
        for _, sample, x in ready:
            x = float("-inf") if x is None else x
            if self.last is not None and self.last[1] > threshold and (self.before is None or self.last[1] > self.before[1]) and self.last[1] >= x:
                closed += self.peaked(*self.last, refractory)
            if self.open is not None and sample - self.peak > refractory:
                closed.append(self.close())
            self.before, self.last = self.last, (sample, x)
        return closed

    def peaked(self, sample: int, x: float, refractory: int) -> list[list]:
        closed = [self.close()] if self.open is not None and sample - self.peak > refractory else []
        if self.open is None or x > self.open[1]:
            self.open = (sample, x)
        self.peak = sample
        return closed

    def close(self) -> list:
        self.number += 1
        own, self.open, self.peak = [self.number, *self.open], None, None
        return own


def stream_blinks(stream_df: DataFrame, threshold: float, refractory: int, min_count: int = 1, watermark: str = "30 seconds") -> DataFrame:
    """(subject, blink, sample, peak) of a stream (subject, ts, sample, value), as they close; a subject's first ones wait for ``min_count``.

    Samples grow with time within a subject. Missing values are no peak and end one. Blinks are numbered from 1 in order.
    """
    rows = stream_df.withWatermark("ts", watermark).select(F.col("subject").cast("string").alias("subject"), "ts", F.col("sample").cast("long").alias("sample"), F.col("value").cast("double").alias("value"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, mark = Blinks(state.get[0] if state.exists else None), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for pdf in parts:
                times = pdf["ts"].astype("int64") // (1_000_000 if str(pdf["ts"].dtype).startswith("datetime64[ns") else 1_000)
                own.waiting += [(int(t), int(s), None if x != x else float(x)) for t, s, x in zip(times, pdf["sample"], pdf["value"], strict=True) if t > own.seen]
        own.held += own.passed(mark, threshold, refractory)
        out = []
        if own.number >= min_count:
            out, own.held = own.held, []
        state.update((own.text(),))
        if own.waiting:
            state.setTimeoutTimestamp(max(mark + 1, min(x[0] for x in own.waiting)))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["subject", "blink", "sample", "peak"])

    return rows.groupBy("subject").applyInPandasWithState(step, "subject string, blink long, sample long, peak double", "kept string", "append", GroupStateTimeout.EventTimeTimeout)
