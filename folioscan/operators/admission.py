"""Admission control: request limits and character budgets by key.

Windows open with a key's first event, not at round times, so each decision
depends on the one before: a fold over a key's events in order. The batch form
keeps one running state a key and streams over its sorted events; the streaming
form (folioscan.streaming.limits) keeps the same state in a state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
CHARS_PER_HOUR = 2_000_000
STORE_BYTES = 150 * 1024 * 1024
DAY_MS = 24 * HOUR_MS


@dataclass
class Budget:
    """A fixed window of `size` ms that opens with the first event after the last one ended."""

    used: int = 0
    until: int = -1
    opened: bool = False

    def request(self, now: int, limit: int, size: int = HOUR_MS) -> bool:
        """Count a request, refused ones as well; the window ends strictly before now."""
        if not self.opened or self.until < now:
            self.used, self.until, self.opened = 0, now + size, True
        self.used += 1
        return self.used <= limit

    def take(self, chars: int, now: int, allowance: int = CHARS_PER_HOUR, size: int = HOUR_MS) -> tuple[bool, int]:
        """(allowed, ms to wait): what would exceed the allowance is refused and not charged."""
        if not self.opened or self.until <= now:
            self.opened, self.until = True, now + size
            self.used = chars if chars <= allowance else 0
            return (True, 0) if chars <= allowance else (False, size)
        if self.used + chars > allowance:
            return False, self.until - now
        self.used += chars
        return True, 0


def decide(events: DataFrame, kind: str, limit: int, size: int = HOUR_MS) -> DataFrame:
    """events (key, at ms, seq, amount) with allowed, used, wait_ms; kind: `requests` or `chars`.

    Rows are dealt out by key, sorted by (key, at, seq) and read as a stream: one key's
    events are never held together in memory. Null keys are one key of their own.
    """
    types = {c: events.schema[c].dataType.simpleString() for c in ("key", "at", "seq", "amount")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), Budget()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                own = None if pd.isna(r.key) else r.key
                if own != key:
                    key, state = own, Budget()
                allowed, wait = (state.request(int(r.at), limit, size), 0) if kind == "requests" else state.take(int(r.amount), int(r.at), limit, size)
                out.append((allowed, state.used, wait if not allowed else 0))
            if out:
                yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["allowed", "used", "wait_ms"])], axis=1)

    rows = events.select("key", "at", "seq", "amount").repartition("key").sortWithinPartitions("key", "at", "seq")
    schema = ", ".join(f"{c} {t}" for c, t in types.items())
    return rows.mapInPandas(run, f"{schema}, allowed boolean, used long, wait_ms long")


def store_is_full(size: Column, ceiling: int = STORE_BYTES) -> Column:
    return size >= ceiling


def megabytes(size: Column) -> Column:
    return F.concat(F.format_number(size / (1024 * 1024), 1), F.lit(" MB"))


def minutes_until(wait_ms: Column) -> Column:
    n = F.greatest(F.lit(1), F.ceil(wait_ms / 60_000)).cast("int")
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(" minute")).otherwise(F.lit(" minutes")))


def unexpired(documents: DataFrame, now: Column) -> DataFrame:
    return documents.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
