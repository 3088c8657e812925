"""Stateful stream operators: one small state for each key, kept by Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECAY = 0.6931471805599453


def deduplicate(events: DataFrame, key: str = "event_id", time: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Each key once; keys are kept until the watermark passes them."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def tumbling_counts(events: DataFrame, key: str = "event_type", time: str = "ts", width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    counts = events.withWatermark(time, lateness).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), key, "n", F.round("total", 6).alias("total"))


def session_counts(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    sessions = events.withWatermark(time, lateness).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return sessions.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def welford_anomalies(events: DataFrame, key: str = "event_type", least: int = 30, threshold: float = 3.0) -> DataFrame:
    """Events whose value lies ``threshold`` deviations from the mean of the key's earlier ones, from ``least`` of
    them on. Within a batch a key's events count in order of time and id."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        ids, zs = [], []
        for event, value in zip(rows["event_id"], rows["value"], strict=True):
            if n >= least and m2 > 0 and abs(z := (value - mean) / (m2 / (n - 1)) ** 0.5) >= threshold:
                ids.append(event), zs.append(round(z, 6))
            n += 1
            delta = value - mean
            mean += delta / n
            m2 += delta * (value - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame({key: [k[0]] * len(ids), "event_id": ids, "z": zs})

    return events.select(key, "event_id", "ts", "value").groupBy(key).applyInPandasWithState(update, f"{key} string, event_id long, z double", "n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)


def decayed_counts(events: DataFrame, key: str = "event_type", half_life_s: float = 86_400.0) -> DataFrame:
    """Per key a count in which each event's weight halves every half life, as of the key's last event."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, last = state.get if state.exists else (0.0, None)
        times = sorted(t.timestamp() for frame in frames for t in frame["ts"])
        for t in times:
            total = total * 2 ** (-(t - last) / half_life_s) + 1 if last is not None else 1.0
            last = t
        state.update((total, last))
        yield pd.DataFrame({key: [k[0]], "attention": [round(total, 6)], "as_of": [last]})

    return events.select(key, "ts").groupBy(key).applyInPandasWithState(update, f"{key} string, attention double, as_of double", "total double, last double", "update", GroupStateTimeout.NoTimeout)


def dgim_add(buckets: list[tuple[int, int]], at: int, window: int) -> list[tuple[int, int]]:
    """Buckets (end, size), newest first, after a 1 at place ``at``: at most two of each size."""
    buckets = [(at, 1), *(b for b in buckets if b[0] > at - window)]
    size = 1
    while True:
        same = [i for i, b in enumerate(buckets) if b[1] == size]
        if len(same) < 3:
            return buckets
        newer, older = same[-2], same[-1]
        buckets[newer] = (buckets[newer][0], 2 * size)
        del buckets[older]
        size *= 2


def dgim_estimate(buckets: list[tuple[int, int]], at: int, window: int) -> int:
    """Ones among the last ``window`` places: the oldest bucket in the window counts half."""
    inside = [b for b in buckets if b[0] > at - window]
    return sum(s for _, s in inside[:-1]) + (inside[-1][1] + 1) // 2 if inside else 0


def dgim_counts(bits: DataFrame, key: str = "key", window: int = 256) -> DataFrame:
    """Per key an estimate of the ones among its last ``window`` bits (key, at, bit), in state of a few numbers."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ends, sizes, at = state.get if state.exists else ([], [], 0)
        buckets = list(zip(ends, sizes, strict=True))
        for place, bit in sorted((p, b) for frame in frames for p, b in zip(frame["at"], frame["bit"], strict=True)):
            at = int(place)
            if bit:
                buckets = dgim_add(buckets, at, window)
        state.update(([b[0] for b in buckets], [b[1] for b in buckets], at))
        yield pd.DataFrame({key: [k[0]], "at": [at], "ones": [dgim_estimate(buckets, at, window)], "buckets": [len(buckets)]})

    return bits.select(key, "at", "bit").groupBy(key).applyInPandasWithState(update, f"{key} string, at long, ones long, buckets long", "ends array<long>, sizes array<long>, at long", "update", GroupStateTimeout.NoTimeout)


def reservoir(events: DataFrame, key: str = "event_id", k: int = 500, seed: int = 7, splits: int = 16) -> DataFrame:
    """(split, h, key): of each split of the keys the k with the least hashes so far; the k least of all splits are a
    uniform sample of the stream, the same as the batch operator's. State is k rows a split, whatever has come."""

    def update(s: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(("h", "id"), state.get, strict=True))) if state.exists else None
        for frame in frames:
            new = frame[["h", "id"]].nsmallest(k, ["h", "id"])
            held = new if held is None else pd.concat([held, new]).nsmallest(k, ["h", "id"])
        state.update((held["h"].tolist(), held["id"].tolist()))
        yield held.assign(split=s[0])[["split", "h", "id"]]

    h = F.xxhash64(key, F.lit(seed))
    rows = events.select(F.pmod(F.shiftright(h, 7), F.lit(splits)).cast("int").alias("split"), h.alias("h"), F.col(key).alias("id"))
    out = rows.groupBy("split").applyInPandasWithState(update, "split int, h long, id long", "hs array<long>, ids array<long>", "update", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("id", key)
