"""Scheduled runs as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scheduled(listings: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs run(batch, number) over what arrived since the last call, then ends: what a scheduler starts every hour.

    A batch that fails is run again with the same rows and number; run has to be idempotent by number.
    """
    return listings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_key(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each key over all time; state grows with the keys, as the rule demands."""
    return stream.dropDuplicates([key])


def first_of_key_within(stream: DataFrame, key: str, at: str, hours: int) -> DataFrame:
    """The bounded variant: repeats later than the watermark pass again."""
    return stream.withWatermark(at, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def fresh(stream: DataFrame, at: str, hours: int) -> DataFrame:
    """Rows within the age limit of the processing time; rows without a time pass."""
    return stream.filter(F.col(at).isNull() | (F.col(at) >= F.current_timestamp() - F.make_interval(hours=F.lit(hours))))


def incidents(stream: DataFrame, key: str, at: str, order: str, hours: int) -> DataFrame:
    """key, order, at of the accepted rows: no accepted earlier row of the key is within the window, both ways in time.

    The state of a key is the times of its accepted rows, which are apart by the window; rows of a batch go by order.
    """
    span = timedelta(hours=hours)

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pd.Timestamp(t, unit="us") for t in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        keep = []
        for i, t in zip(rows.index, rows[at]):
            if not any(abs(t - h) <= span for h in held):
                held.append(t)
                keep.append(i)
        state.update(([int(h.value // 1000) for h in held],))
        yield rows.loc[keep, [key, order, at]]

    kinds = dict(stream.dtypes)
    cut = stream.select(key, order, at).filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    return cut.groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {order} {kinds[order]}, {at} {kinds[at]}", "times array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
