"""Comparison again and again: when a file changes, or for every batch of a stream."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.compare import compare
from tidemark.plans.findings import DiffResult


def _stamps(paths: tuple[str, ...]) -> tuple:
    newest = lambda p: max([os.stat(p).st_mtime_ns, *(os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(p) for f in names)])
    return tuple(newest(p) if os.path.exists(p) else None for p in paths)


def watch(paths: tuple[str, ...], rerun: Callable[[], object], every: float = 1.0, rounds: int | None = None, failed: Callable[[Exception], object] | None = None) -> int:
    """Call rerun when one of paths changes; both sides are watched. rounds bounds the looks (None: for ever); returns the reruns.

    A rerun that fails, as on a file that is still being written, does not end the watch: `failed` is told, and the next look tries again.
    """
    seen, n = _stamps(paths), 0
    while rounds is None or rounds > 0:
        time.sleep(every)
        if (now := _stamps(paths)) != seen and None not in now:
            seen, n = now, n + 1
            try:
                rerun()
            except Exception as e:
                (failed or (lambda _: None))(e)
                seen = ()  # not even the same state has been compared
        rounds = None if rounds is None else rounds - 1
    return n


def compare_stream(before: DataFrame, after: DataFrame, consume: Callable[[int, DiffResult], None], checkpoint: str, scenario: str = "general", **how) -> StreamingQuery:
    """Compare each micro-batch of the streaming DataFrame `after` with the static `before`; all that is available, then stop."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            consume(epoch, compare(before, df, scenario, **how))
        finally:
            df.unpersist()

    return after.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
