"""Keyed limits and event-time windows, for streams and for tables alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.admission import HOUR_MS, Budget

DECISIONS = "key string, at long, seq long, amount long, allowed boolean, used long, wait_ms long"


def limit_stream(events: DataFrame, kind: str, limit: int, size: int = HOUR_MS, lateness: str | None = None) -> DataFrame:
    """The decisions of admission.decide() over a stream of (key, at, seq, amount).

    A key's window is kept in the state store. With `lateness` it is closed by time: once the stream's
    clock (the latest event less the lateness) is past the window's end, the key's state goes, so that what is
    kept follows the keys that are active, not all that ever were; an event that is later than that clock is
    dropped, as in any stream with a watermark. Without it, states stay and no event is late. Events of one micro-batch are taken in order of (at, seq); an
    event that comes in a later batch is judged then, whatever its time says.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        budget = Budget(*state.get) if state.exists else Budget()
        pdf = pd.concat(list(batches)).sort_values(["at", "seq"], ignore_index=True)
        out = []
        for r in pdf.itertuples(index=False):
            allowed, wait = (budget.request(int(r.at), limit, size), 0) if kind == "requests" else budget.take(int(r.amount), int(r.at), limit, size)
            out.append((r.key, r.at, r.seq, r.amount, allowed, budget.used, wait if not allowed else 0))
        state.update((budget.used, budget.until, budget.opened))
        if lateness:
            if budget.until + 1 > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(budget.until + 1)
            else:
                state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])

    keyed = events.select(F.col("key").cast("string").alias("key"), F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("amount").cast("long").alias("amount"))
    if lateness:
        keyed = keyed.withColumn("time", F.timestamp_millis("at")).withWatermark("time", lateness)
    return keyed.groupBy("key").applyInPandasWithState(step, DECISIONS, "used long, until long, opened boolean", "append", "EventTimeTimeout" if lateness else "NoTimeout")


def _late(events: DataFrame, time: str, lateness: str | None) -> DataFrame:
    return events.withWatermark(time, lateness) if lateness and events.isStreaming else events


def tumbling(events: DataFrame, time: str, length: str, *measures: Column, by: tuple[str, ...] = (), lateness: str | None = None) -> DataFrame:
    """Measures for each window of `length`; a stream drops what is later than `lateness`."""
    w = F.window(time, length)
    return _late(events, time, lateness).groupBy(w, *by).agg(*measures).select(F.col("window.start").alias("start"), *by, *[c for c in _names(measures)])


def sessions(events: DataFrame, time: str, gap: str, *measures: Column, by: tuple[str, ...] = (), lateness: str | None = None) -> DataFrame:
    """Measures for each run of events with less than `gap` between neighbours."""
    w = F.session_window(time, gap)
    return _late(events, time, lateness).groupBy(w, *by).agg(*measures).select(F.col("session_window.start").alias("start"), *by, *[c for c in _names(measures)])


def _names(measures: tuple[Column, ...]) -> list[str]:
    return [c._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for c in measures]
