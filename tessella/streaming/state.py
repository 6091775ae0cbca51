"""Streams with state of their own for each key: a cache with a time to live, and which workers are alive.

Both go by event time. A state is dropped when the watermark passes its end, so the store holds what is live only.
Rows of a key within a batch are taken in the order of their times; a row older than what its key has seen is
late and takes the state as it finds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MINUTE = 60_000_000  # in microseconds, as all times here


def _micros(times: pd.Series) -> list[int]:
    return pd.to_datetime(times, utc=True).dt.as_unit("us").astype("int64").tolist()


def _times(micros: list[int]) -> pd.Series:
    return pd.Series(pd.to_datetime(micros, unit="us", utc=True)).dt.tz_localize(None)


def cached(requests: DataFrame, key: list[str], ident: str, ttl: str = "ttl", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(ident, hit, stored): whether a request finds a result of its key that is younger than its time to live.

    requests has the times to live in seconds as a column, so kinds of results can live for different times. A
    request without a hit stores its result anew; hits don't prolong it.
    """
    types = dict(requests.dtypes)
    schema = f"{ident} {types[ident]}, hit boolean, stored timestamp"

    def look(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([time, ident], kind="stable")
        stored, ends = state.get if state.exists else (None, None)
        hits, when = [], []
        for at, live in zip(_micros(rows[time]), rows[ttl].tolist(), strict=True):
            hit = stored is not None and at < ends
            if not hit:
                stored, ends = at, at + int(live * 1_000_000)
            hits.append(hit)
            when.append(stored)
        state.update((stored, ends))
        state.setTimeoutTimestamp(max(ends // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({ident: rows[ident].to_numpy(), "hit": hits, "stored": _times(when)})

    grouped = requests.withWatermark(time, delay).groupBy(*key)
    return grouped.applyInPandasWithState(look, schema, "stored long, ends long", "append", GroupStateTimeout.EventTimeTimeout)


def departures(beats: DataFrame, worker: str, time: str = "ts", silence: int = 120, forget: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """(worker, joined, left, beats): workers that gave no beat for `silence` seconds, when that was, and their beats
    in the last `forget` seconds before. A worker that beats again joins again.

    A worker's state is its first and last beat and its beats within `forget`, older ones being dropped.
    """
    schema = f"{worker} {dict(beats.dtypes)[worker]}, joined timestamp, left timestamp, beats long"
    quiet, memory = silence * 1_000_000, forget * 1_000_000

    def watch(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, seconds, counts = state.get if state.exists else (None, None, [], [])
        held = dict(zip(seconds, counts, strict=True))
        gone: list[tuple[int, int, int]] = []

        def leave() -> None:
            gone.append((first, last + quiet, sum(n for at, n in held.items() if at > last - memory)))

        if state.hasTimedOut:
            leave()
            state.remove()
        else:
            for at in sorted(_micros(pd.concat(list(frames))[time])):
                if last is None or at - last > quiet:
                    if last is not None:
                        leave()
                    first, held = at, {}
                last = at if last is None else max(last, at)
                held[at] = held.get(at, 0) + 1
                if len(held) > 64 and min(held) <= last - memory:
                    held = {s: n for s, n in held.items() if s > last - memory}
            held = {s: n for s, n in held.items() if s > last - memory}
            state.update((first, last, list(held), list(held.values())))
            state.setTimeoutTimestamp(max((last + quiet) // 1000, state.getCurrentWatermarkMs() + 1))
        if gone:
            yield pd.DataFrame({worker: [name[0]] * len(gone), "joined": _times([g[0] for g in gone]), "left": _times([g[1] for g in gone]), "beats": [g[2] for g in gone]})

    grouped = beats.withWatermark(time, delay).groupBy(worker)
    return grouped.applyInPandasWithState(watch, schema, "first long, last long, seconds array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
