"""Admission of events that were not seen before, by Bloom filters in the stream's state.

Ids are dealt over many small filters by their hash; each is a state of its own, so the work spreads over the state's
partitions whatever the keys are, and a batch rewrites only the filters it touches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Filters, bits of each, places of an id, ids after which a filter becomes the old one.
FILTERS, BITS, PLACES, CAPACITY = 64, 1 << 18, 7, 1 << 14
_BIT = np.uint64(1)


def expected_rate(ids_in_filter: float, bits: int = BITS, places: int = PLACES) -> float:
    """Share of new ids that a filter of so many takes for old ones."""
    return float((1 - np.exp(-places * ids_in_filter / bits)) ** places)


def add_if_absent(words: np.ndarray, old: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the ids (a row of places each, no id twice) neither filter holds; those are added to ``words``."""
    held = lambda w: ((w[places >> 6] >> (places & 63).astype(np.uint64)) & _BIT).all(axis=1)
    fresh = ~(held(words) | held(old))
    at = places[fresh].reshape(-1)
    np.bitwise_or.at(words, at >> 6, _BIT << (at & 63).astype(np.uint64))
    return fresh


def admit(events: DataFrame, key: str = "event_id", filters: int = FILTERS, bits: int = BITS, places: int = PLACES, capacity: int = CAPACITY) -> DataFrame:
    """``events`` with ``admitted``: whether its key came for the first time, as far as the filters can tell. A repeat is
    never admitted while its filter, or the one before, remembers it: after ``capacity`` new ids a filter becomes the
    old one, and the one before is forgotten. A new key is refused at the expected rate of false positives. Within a
    batch the first row of a key is the one admitted. Null keys are one key."""
    names = events.columns
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit(17)).bitwiseOR(F.lit(1))
    rows = events.withColumns({"__h1": h1, "__h2": h2, "__filter": F.pmod(h1, F.lit(filters)).cast("int")})
    schema = StructType([*events.schema.fields]).add("admitted", "boolean")

    def update(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            held, before, n = state.get
            words, old = np.frombuffer(held, np.uint64).copy(), np.frombuffer(before, np.uint64)
        else:
            words, old, n = np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64), 0
        for frame in frames:
            h = frame["__h1"].to_numpy().astype(np.uint64)
            step = frame["__h2"].to_numpy().astype(np.uint64)
            first = np.zeros(len(h), bool)
            first[np.unique(h, return_index=True)[1]] = True
            at = np.flatnonzero(first)
            with np.errstate(over="ignore"):
                spots = ((h[at, None] >> np.uint64(8)) + np.arange(places, dtype=np.uint64) * step[at, None]) % np.uint64(bits)
            admitted = np.zeros(len(h), bool)
            admitted[at] = add_if_absent(words, old, spots.astype(np.int64))
            n += int(admitted.sum())
            if n >= capacity:
                words, old, n = np.zeros(bits // 64, np.uint64), words, 0
            yield frame[names].assign(admitted=admitted)
        state.update((words.tobytes(), old.tobytes(), n))

    return rows.groupBy("__filter").applyInPandasWithState(update, schema, "held binary, before binary, n long", "append", GroupStateTimeout.NoTimeout)


def _known(runs: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """Which hashes are in any of the sorted runs."""
    out = np.zeros(len(h), bool)
    for run in runs:
        at = np.minimum(np.searchsorted(run, h), len(run) - 1)
        out |= run[at] == h
    return out


def _kept(runs: list[np.ndarray], h: np.ndarray) -> None:
    """Add new hashes as a run. Runs of like lengths are merged, so each hash is moved a few times only."""
    if len(h):
        runs.append(np.sort(h))
        while len(runs) > 1 and len(runs[-2]) < 2 * len(runs[-1]):
            runs[-2:] = [np.sort(np.concatenate(runs[-2:]), kind="stable")]


def admit_exactly(events: DataFrame, key: str = "event_id", filters: int = FILTERS, bits: int = BITS, places: int = PLACES, capacity: int = CAPACITY) -> DataFrame:
    """``events`` with ``admitted``: whether its key came for the first time, of all keys that ever came. A key that the
    filters don't hold is new; one that they hold is looked up among the keys of the state, so none is refused by
    chance. A full filter stays and one of twice the size is begun, so a key is tried in few filters. The state grows
    with the keys, by a hash of 64 bits each, which differs for different whole numbers. Within a batch the first row
    of a key is the one admitted. Null keys are one key."""
    names = events.columns
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit(17)).bitwiseOR(F.lit(1))
    rows = events.withColumns({"__h1": h1, "__h2": h2, "__filter": F.pmod(h1, F.lit(filters)).cast("int")})
    schema = StructType([*events.schema.fields]).add("admitted", "boolean")
    size = lambda k: bits // 64 << k

    def update(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ids, n = state.get if state.exists else (bytes(8 * size(0)), b"", 0)
        words, parts = np.frombuffer(held, np.uint64).copy(), []
        while words.size:
            parts.append(words[: size(len(parts))])
            words = words[parts[-1].size :]
        runs = [np.frombuffer(ids, np.uint64)] if ids else []
        for frame in frames:
            h = frame["__h1"].to_numpy().astype(np.uint64)
            step = frame["__h2"].to_numpy().astype(np.uint64)
            at = np.sort(np.unique(h, return_index=True)[1])
            with np.errstate(over="ignore"):
                spots = (h[at, None] >> np.uint64(8)) + np.arange(places, dtype=np.uint64) * step[at, None]
            maybe = np.zeros(len(at), bool)
            for part in parts:
                place = (spots % np.uint64(64 * part.size)).astype(np.int64)
                maybe |= ((part[place >> 6] >> (place & 63).astype(np.uint64)) & _BIT).all(axis=1)
            fresh = ~maybe
            fresh[maybe] = ~_known(runs, h[at[maybe]])
            place = (spots[fresh] % np.uint64(64 * parts[-1].size)).astype(np.int64).reshape(-1)
            np.bitwise_or.at(parts[-1], place >> 6, _BIT << (place & 63).astype(np.uint64))
            _kept(runs, h[at[fresh]])
            admitted = np.zeros(len(h), bool)
            admitted[at[fresh]] = True
            n += int(fresh.sum())
            if n >= capacity << (len(parts) - 1):
                parts.append(np.zeros(size(len(parts)), np.uint64))
                n = 0
            yield frame[names].assign(admitted=admitted)
        every = np.sort(np.concatenate(runs), kind="stable") if runs else np.zeros(0, np.uint64)
        state.update((np.concatenate(parts).tobytes(), every.tobytes(), n))

    return rows.groupBy("__filter").applyInPandasWithState(update, schema, "held binary, ids binary, n long", "append", GroupStateTimeout.NoTimeout)


def admission_report(judged: DataFrame, key: str = "event_id", filters: int = FILTERS, bits: int = BITS, places: int = PLACES) -> DataFrame:
    """One row: events, admitted, repeats that were admitted, new keys that were refused, and whether their share is no
    more than expected, all against the exact set of keys."""
    keys = judged.groupBy(key).agg(F.count("*").alias("n"), F.count_if("admitted").alias("times"))
    sums = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.coalesce(F.sum("times"), F.lit(0)).alias("admitted"), F.count_if(F.col("times") > 1).alias("repeats_admitted"), F.count_if(F.col("times") == 0).alias("new_refused"), F.count("*").alias("keys"))
    expected = F.pow(1 - F.exp(-places * F.col("keys") / (filters * bits)), places)
    # three standard deviations above the expected number
    bound = expected * F.col("keys") + 3 * F.sqrt(expected * F.col("keys"))
    return sums.select("events", "admitted", "repeats_admitted", "new_refused", (F.col("new_refused") <= F.ceil(bound)).alias("as_expected"))
