"""Counted window closing as a stateful stream operator: emit once when the marks are full.

A window's state, the sum of its marks or that it is closed, is kept until the watermark passes the window by its own
span; then it is removed, and marks that are later still are dropped. So state grows with the windows in flight alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def close_counted(units: DataFrame, span_ms: int = 86_400_000, lateness: str = "2 days") -> DataFrame:
    """`units` is a stream of rows (wid, n, num, den), windows of `span_ms`; the output has each complete window once.

    Marks of a window that starts `lateness` before the newest one, or earlier, no longer count.
    """

    def update(key: tuple, blocks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        num, count = state.get if state.exists else (0, 0)
        den = 1
        for b in blocks:
            if num >= 0:
                num, count, den = num + int(b["num"].sum()), count + int(b["n"].sum()), int(b["den"].max())
        if num >= den:
            yield pd.DataFrame({"wid": [key[0]], "cnt": [count]})
            num, count = -1, 0  # closed: marks that come later are late
        state.update((num, count))
        state.setTimeoutTimestamp(max((int(key[0]) + 2) * span_ms, state.getCurrentWatermarkMs() + 1))

    timed = units.withColumn("at", F.timestamp_millis(F.col("wid") * span_ms)).withWatermark("at", lateness)
    return timed.groupBy("wid").applyInPandasWithState(
        update, "wid long, cnt long", "num long, cnt long", "append", GroupStateTimeout.EventTimeTimeout
    )
