"""Directly-follows flows of a stream of object events, kept up to date by object."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "otype string, src_act string, dst_act string, src_eid string, dst_eid string"
_STATE = "eid string, activity string, held_micros array<bigint>, held_eids array<string>, held_activities array<string>"


def _pairs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    eid, activity, *held = tuple(state.get) if state.exists else (None, None, [], [], [])
    events = set(zip(*held, strict=True))
    if not state.hasTimedOut:
        for frame in frames:
            events |= set(zip(frame["micros"].tolist(), frame["eid"].tolist(), frame["activity"].tolist(), strict=True))
    watermark = state.getCurrentWatermarkMs()
    done = sorted(e for e in events if e[0] <= watermark * 1000)  # nothing of this or an earlier time can come
    out = []
    for _, e, a in done:
        if eid is not None and e != eid:
            out.append((key[0], activity, a, eid, e))
        eid, activity = e, a
    rest = sorted(events.difference(done))
    state.update((eid, activity, *([list(c) for c in zip(*rest, strict=True)] if rest else [[], [], []])))
    if rest:
        state.setTimeoutTimestamp(max(rest[0][0] // 1000, watermark) + 1)
    yield pd.DataFrame(out, columns=["otype", "src_act", "dst_act", "src_eid", "dst_eid"])


def streamed_successions(relations: DataFrame, late: str = "2 hours") -> DataFrame:
    """Successions from a stream of relations (eid, oid, otype, activity, ts).

    An object's events are held until the watermark has passed them and then taken in order of ts and eid,
    so that events which come out of order, up to ``late``, give what the batch operator gives.
    Later ones are dropped by Spark. State is the last event of each object and those that are held. Repeated
    relations count once.
    """
    ts = F.col("ts").cast("timestamp")
    r = relations.select("otype", "oid", "eid", "activity", ts.alias("ts"), F.unix_micros(ts).alias("micros")).withWatermark("ts", late)
    return r.groupBy("otype", "oid").applyInPandasWithState(_pairs, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_activity_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per activity and window of event time; events later than the watermark are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "activity").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "activity", "events")
