"""Streams of versioned requests: stale ones are dropped, repeated ones are taken once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def newest_only(events: DataFrame, key: str, version: str, item: str) -> DataFrame:
    """key, version, item of the events whose version is no older than the newest that their key has shown so far.

    Within a micro-batch events count in the order of (version's column order of arrival isn't kept) their item; the
    state of a key is one number. Null keys or versions are dropped.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else -(2**62)
        for pdf in batches:
            pdf = pdf.sort_values(item, kind="stable")
            top = pdf[version].cummax().clip(lower=newest)
            newest = max(newest, int(pdf[version].max()))
            kept = pdf[pdf[version] >= top]
            yield pd.DataFrame({key: [keys[0]] * len(kept), version: kept[version].to_numpy(), item: kept[item].to_numpy()})
        state.update((newest,))

    kind = dict(events.dtypes)
    e = events.where(F.col(key).isNotNull() & F.col(version).isNotNull()).select(key, version, item)
    return e.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {version} {kind[version]}, {item} {kind[item]}", "newest long", "append", GroupStateTimeout.NoTimeout)


def once_within(events: DataFrame, time: str, delay: str, *columns: str) -> DataFrame:
    """Events without those that repeat the columns within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(columns))


def counts_per_window(events: DataFrame, time: str, delay: str, length: str, *columns: str) -> DataFrame:
    """Counts per window of event time; rows later than the delay are left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, length), *columns).agg(F.count(F.lit(1)).alias("n"))
