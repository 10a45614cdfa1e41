"""Live telemetry on streams whose state outlives micro-batches: newest values, rate limits, caps, rings, heartbeats.

Each operator keeps a few numbers (or, a ring, its rows) for each key in the state store, so that a restart from the
checkpoint goes on where it stopped. Rows of a micro-batch are taken in the order of `order`, chunk by chunk: a task holds a chunk
and what the operator keeps, however many rows a key has. The state store must be RocksDB: see rocksdb().
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's setting is as before after it."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _plain(values) -> tuple:
    """Python values of a row, as the state store takes them."""
    return tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in values)


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, out: list[T.StructField], mode: str = "append", time: str = "None") -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=T.StructType(out), outputMode=mode, timeMode=time)


class _Latest(StatefulProcessor):
    def __init__(self, kept: T.StructType, order: list[str], ttl_ms: int | None):
        self.kept, self.order, self.ttl_ms = kept, order, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("latest", self.kept, self.ttl_ms) if self.ttl_ms else handle.getValueState("latest", self.kept)

    def handleInputRows(self, key, rows, timerValues):
        *newest, dropped = self.state.get() if self.state.exists() else (None, -1)
        newest, n = newest if len(newest) > 1 else None, len(self.order)
        for chunk in rows:
            dropped += len(chunk)
            row = _plain(chunk.sort_values(self.order, kind="stable")[[f.name for f in self.kept.fields[:-1]]].iloc[-1])
            if newest is None or tuple(newest[:n]) <= row[:n]:
                newest = row
        self.state.update((*newest, dropped))
        yield pd.DataFrame([(*key, *newest, dropped)], columns=[*self.names, *self.kept.names])

    def close(self) -> None:
        pass


def latest(stream: DataFrame, key: str, order: list[str], values: list[str], ttl_ms: int | None = None) -> DataFrame:
    """(key, order, values, dropped): for each micro-batch and key in it the newest row so far, and how many rows gave way to it.

    Rows older than the newest only count. With ttl_ms a key's state goes when nothing has come for so long (in processing time), and it
    starts anew; such a query runs until it is stopped. Columns of order aren't null.
    """
    kept = T.StructType([*_fields(stream, *order, *values), T.StructField("dropped", T.LongType())])
    processor = _Latest(kept, order, ttl_ms)
    processor.names = [key]
    return _stateful(stream.select(key, *order, *values), key, processor, [*_fields(stream, key), *kept.fields], "update", "processingTime" if ttl_ms else "None")


class _Sampled(StatefulProcessor):
    def __init__(self, names: list[str], time_s: str, order: str, hz: float):
        self.names, self.time_s, self.order, self.hz = names, time_s, order, hz

    def init(self, handle) -> None:
        self.state = handle.getValueState("slot", T.StructType([T.StructField("slot", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        last = self.state.get()[0] if self.state.exists() else None
        found = None
        for chunk in rows:
            chunk = chunk.assign(slot=(chunk[self.time_s] * self.hz).map(math.floor))
            if last is not None:
                chunk = chunk[chunk.slot > last]
            found = chunk if found is None else pd.concat([found, chunk])
            found = found.sort_values([self.time_s, self.order], kind="stable").drop_duplicates("slot")
        if len(found):
            self.state.update((int(found.slot.max()),))
            yield found[self.names]

    def close(self) -> None:
        pass


def sampled(stream: DataFrame, key: str, time_s: str, order: str, hz: float) -> DataFrame:
    """Rows with their slot: of each 1/hz slot of a key the first row. Rows of a slot that is over, or has its row, give way."""
    out = [*_fields(stream, *stream.columns), T.StructField("slot", T.LongType())]
    return _stateful(stream, key, _Sampled([f.name for f in out], time_s, order, hz), out)


class _Capped(StatefulProcessor):
    def __init__(self, key: str, order: list[str], most: int):
        self.key, self.order, self.most = key, order, most

    def init(self, handle) -> None:
        self.state = handle.getValueState("counts", T.StructType([T.StructField("taken", T.LongType()), T.StructField("dropped", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        taken, dropped = self.state.get() if self.state.exists() else (0, 0)
        room, found, n = self.most - taken, None, 0
        for chunk in rows:
            n += len(chunk)
            found = chunk if found is None else pd.concat([found, chunk])
            found = found.sort_values(self.order, kind="stable").head(room)
        self.state.update((taken + len(found), dropped + n - len(found)))
        found = found.assign(position=range(taken, taken + len(found)), dropped=None)
        if n > len(found):
            found = pd.concat([found, pd.DataFrame([{self.key: key[0], "dropped": dropped + n - len(found)}])])
        yield found[[self.key, *self.order, "position", "dropped"]].astype({"position": "Int64", "dropped": "Int64", **{c: "Int64" for c in self.order if found[c].dtype == object or str(found[c].dtype).startswith("float") and self.whole[c]}})

    def close(self) -> None:
        pass


def capped(stream: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """(key, order, position, dropped): a key's first `most` rows, as they come, each with its position; and where rows gave
    way, a row for the micro-batch that has no order and position but the key's dropped rows so far."""
    processor = _Capped(key, order, most)
    processor.whole = {c: isinstance(stream.schema[c].dataType, T.IntegralType) for c in order}
    number = [T.StructField(x, T.LongType()) for x in ("position", "dropped")]
    return _stateful(stream.select(key, *order), key, processor, [*_fields(stream, key, *order), *number])


class _Ring(StatefulProcessor):
    def __init__(self, key: str, kept: T.StructType, order: list[str], size: int):
        self.key, self.kept, self.order, self.size = key, kept, order, size

    def init(self, handle) -> None:
        self.rows = handle.getListState("ring", self.kept)
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("seen", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        seen = self.seen.get()[0] if self.seen.exists() else 0
        found = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=self.kept.names)
        for chunk in rows:
            seen += len(chunk)
            chunk = chunk[self.kept.names]
            found = chunk if found.empty else pd.concat([found, chunk])
            found = found.sort_values(self.order, kind="stable", ascending=False).head(self.size)
        self.seen.update((seen,))
        self.rows.put([_plain(r) for r in found.itertuples(index=False)])
        yield found.assign(**{self.key: key[0], "age": range(len(found)), "seen": seen})[[self.key, *self.kept.names, "age", "seen"]]

    def close(self) -> None:
        pass


def ring(stream: DataFrame, key: str, order: list[str], values: list[str], size: int = 120) -> DataFrame:
    """(key, order, values, age, seen): for each micro-batch and key in it, its newest `size` rows (age 0 the newest) after so many rows were seen."""
    kept = T.StructType(_fields(stream, *order, *values))
    out = [*_fields(stream, key), *kept.fields, T.StructField("age", T.LongType()), T.StructField("seen", T.LongType())]
    return _stateful(stream.select(key, *kept.names), key, _Ring(key, kept, order, size), out, "update")


class _Heartbeats(StatefulProcessor):
    """State: the key's last row's time, how many beats it has had since, when its timer is due."""

    def __init__(self, key: str, gap_us: int, live: bool):
        self.key, self.gap_us, self.live = key, gap_us, live

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", T.StructType([T.StructField(x, T.LongType()) for x in ("last", "beats", "due")]))

    def _wait(self, last: int, beats: int) -> None:
        due = -(-(last + (beats + 1) * self.gap_us) // 1000)
        self.handle.registerTimer(due)
        self.state.update((last, beats, due))

    def _told(self, key, last: int, first: int, stop: int) -> list[tuple]:
        return [(key[0], last, n, last + n * self.gap_us) for n in range(first, stop)]

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "after_us", "beat", "at_us"])

    def handleInputRows(self, key, rows, timerValues):
        last, beats, due = self.state.get() if self.state.exists() else (None, 0, None)
        if due is not None:
            self.handle.deleteTimer(due)
        told = []
        if self.live:  # a row is as late as it arrives
            for _ in rows:
                pass
            last, beats = timerValues.getCurrentProcessingTimeInMs() * 1000, 0
        else:
            runs = []  # stretches without a silence: as few as there are silences
            for chunk in rows:
                runs = _joined(runs + [(t, t) for t in sorted(chunk.at_us)], self.gap_us)
            for begin, end in runs:
                if last is not None and begin > last:
                    told += self._told(key, last, beats + 1, -(-(begin - last) // self.gap_us))
                if last is None or end > last:
                    last, beats = end, 0
        self._wait(last, beats)
        yield self._frame(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, beats, _ = self.state.get()
        now = (timerValues.getCurrentProcessingTimeInMs() if self.live else timerValues.getCurrentWatermarkInMs()) * 1000
        due = max(beats, (now - last) // self.gap_us)
        self._wait(last, due)
        yield self._frame(self._told(key, last, beats + 1, due + 1))

    def close(self) -> None:
        pass


def _joined(runs: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Stretches that lie at most gap apart, as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(runs):
        if out and begin - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def heartbeats(stream: DataFrame, key: str, time: str, gap_s: float, lateness: str = "0 seconds", live: bool = False) -> DataFrame:
    """(key, after_us, beat, at_us): a beat for every gap_s of a key's silence, counted since its row at after_us.

    In event time by default: silence between two rows is told when the second comes, and silence after the last one as
    far as the watermark (the newest time of all keys less lateness) has come, by timers; a row later than lateness is left out. live: silence of
    the wall clock, told by processing-time timers until the query is stopped; after_us is when the last row arrived.
    """
    rows = stream.withWatermark(time, lateness) if not live else stream
    rows = rows.select(key, time, F.unix_micros(time).alias("at_us"))
    out = [*_fields(stream, key), *[T.StructField(x, T.LongType()) for x in ("after_us", "beat", "at_us")]]
    return _stateful(rows, key, _Heartbeats(key, round(gap_s * 1e6), live), out, "append", "processingTime" if live else "eventTime")
