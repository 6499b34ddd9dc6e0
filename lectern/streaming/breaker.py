"""A circuit breaker for hosts over a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def breaker_stream(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """host, attempts, refused, open after each batch, from a stream of (host, ts, failed).

    `limit` failures in a row open a host's circuit for good; what comes then
    is refused. The state of a host is three numbers. Within a batch a host's
    attempts count in order of ts. A null failed counts as a failure.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, total, refused = state.get if state.exists else (0, 0, 0)
        for failed in pd.concat(list(batches)).sort_values("ts")["failed"]:
            total += 1
            if streak >= limit:
                refused += 1
            else:
                streak = 0 if failed is not None and failed == failed and not failed else streak + 1
        state.update((streak, total, refused))
        yield pd.DataFrame({"host": [key[0]], "attempts": [total], "refused": [refused], "open": [streak >= limit]})

    return attempts.select("host", "ts", "failed").groupBy("host").applyInPandasWithState(
        step, "host string, attempts long, refused long, open boolean", "streak long, total long, refused long", "update", GroupStateTimeout.NoTimeout
    )
