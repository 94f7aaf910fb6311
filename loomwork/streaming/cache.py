"""A cache whose entries expire, as state of a stream: versions come in any order, the newest that is still valid counts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Microseconds since the epoch at which an entry that never expires does.
NEVER = 2**63 - 1
_VERSION = "id bigint, at bigint, expires bigint"


def worth_keeping(versions: list[tuple[int, int, int]], now: int) -> list[tuple[int, int, int]]:
    """Of (at, id, expires), newest first, those that can still be the newest valid one: not expired, and longer lived
    than all that are newer."""
    kept: list[tuple[int, int, int]] = []
    for v in sorted(set(versions), reverse=True):
        if v[2] > now and (not kept or v[2] > kept[-1][2]):
            kept.append(v)
    return kept


class Versions(StatefulProcessor):
    """Keeps of each key the versions that may be asked for, and tells the newest valid one after each batch and expiry."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle) -> None:
        self.handle = handle
        self.versions = handle.getListState("versions", _VERSION)

    def _answer(self, key: tuple, kept: list[tuple[int, int, int]], now: int) -> pd.DataFrame:
        newest = kept[0] if kept else None
        row = dict(zip(self.keys, [[k] for k in key])) | {"id": [newest[1] if newest else None], "expires": [newest[2] if newest and newest[2] != NEVER else None], "asked": [now]}
        out = pd.DataFrame(row)
        return out.astype({"id": "Int64", "expires": "Int64", "asked": "Int64"})

    def _store(self, kept: list[tuple[int, int, int]]) -> None:
        if not kept:
            self.versions.clear()
            return
        self.versions.put([(i, at, end) for at, i, end in kept])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        ends = kept[0][2]
        if ends != NEVER:
            self.handle.registerTimer(-(-ends // 1000))  # timers are in milliseconds

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        versions = [(at, i, end) for i, at, end in self.versions.get()] if self.versions.exists() else []
        for b in rows:
            versions += [(int(at), int(i), NEVER if pd.isna(end) else int(end)) for at, i, end in zip(b["at"], b["id"], b["expires"])]
        kept = worth_keeping(versions, now)
        self._store(kept)
        yield self._answer(key, kept, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        kept = worth_keeping([(at, i, end) for i, at, end in self.versions.get()] if self.versions.exists() else [], now)
        self._store(kept)
        yield self._answer(key, kept, now)

    def close(self) -> None:
        pass


def valid_versions(versions: DataFrame, *, keys: list[str], id: str, at: str, expires: str, late: str = "10 minutes") -> DataFrame:
    """The keys, id, expires and asked (microseconds) whenever a key's newest valid version may have changed.

    The time asked for is the watermark: ``late`` behind the greatest ``at`` seen.  A null ``expires`` never does.  Only versions
    that may still be the answer are kept as state, so it is bounded by what is alive; a key without any keeps none.
    Versions later than the watermark are dropped by the stream.  The session needs the RocksDB state store.
    """
    # the process that readies a stream's state does not see the session's module path
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = versions.withWatermark(at, late).select(at, *keys, F.col(id).cast("long").alias("id"), micros(at).alias("at"), micros(expires).alias("expires"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    grouped = rows.groupBy(*keys)
    return grouped.transformWithStateInPandas(statefulProcessor=Versions(keys), outputStructType=f"{kinds}, id bigint, expires bigint, asked bigint", outputMode="Update", timeMode="EventTime")
