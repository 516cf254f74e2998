"""Readings of a stream in time order, per series, with keyed state and event-time timers.

A reading waits in list state until the watermark has passed its time; a timer set at the first
waiting time then releases it and all others that are due, in order of time (then of arrival), each
with the reading before it in its series. So a reading that arrives late, but within the lateness,
changes no result. Whether a reading lies after the one that arrived before it is judged when it
arrives. Series that stay silent are forgotten when a timer finds that they have expired.

State is keyed by bucket, a hash of the series: a call takes the rows of all series of a bucket at
once, on arrays, and a bucket has one timer, for whichever of its series comes first. So the calls
of a micro-batch follow the buckets and its work follows the rows, however many series there are.

A series' waiting readings are bounded by its rate times the lateness. Readings that arrive later
than the lateness are dropped by Spark's watermark and counted (``dropped_by_watermark``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from helioquant.operators.counters import FLAG_DAILY_DROP, FLAG_MONOTONIC, FLAG_NOT_CHRONOLOGICAL

SERIES = ("plant", "device", "signal_key")
EXPIRY_S = 30 * 86_400
#: Belongs to a checkpoint, as the number of its state partitions does.
BUCKETS = 256
#: Keyed timers and list state need this provider; a session's default keeps state on the heap.
STATE_PROVIDER = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
# timer: time it is set to; series: name, last (newest released) time and value, time of the newest arrival.
CLOCK_SCHEMA = "timer long, series binary"
# Readings of one micro-batch, or those a timer left: place of the series in names, ts, value, arrival, late.
WAITING_SCHEMA = "names binary, readings binary"
STEP_FIELDS = (
    "ts timestamp, value double, arrival long, prev_ts timestamp, prev_value double, step double, "
    "out_of_order boolean"
)
#: A series is named by its keys as JSON, whatever their types.
KEY_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: No time, as micros (numpy's NaT), and no arrival number, which comes after all others.
NO_TIME, NO_ARRIVAL = -(2**63), 2**63 - 1


def _millis(micros):
    """The first millisecond at or after a time."""
    return -(-micros // 1000)


def _packed(**columns) -> bytes:
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()
    return {name: table[name].to_numpy() for name in table.column_names}


def _firsts(codes: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its run."""
    return np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]


def _before(values: np.ndarray, firsts: np.ndarray, first_values: np.ndarray) -> np.ndarray:
    """The value of the row before, and for the first rows the given ones."""
    return np.where(firsts, first_values, np.concatenate([values[:1], values[:-1]]))


class TimeOrder(StatefulProcessor):
    """Releases the readings of a bucket of series in time order, each with the one before it in its series."""

    def __init__(self, expiry_s: int = EXPIRY_S) -> None:
        self.expiry_ms = expiry_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK_SCHEMA)
        self.waiting = handle.getListState("waiting", WAITING_SCHEMA)

    def close(self) -> None:
        pass

    def _read_clock(self) -> tuple[int | None, dict[str, np.ndarray]]:
        if self.clock.exists():
            timer, series = self.clock.get()
            return timer, _unpacked(series)
        none = np.empty(0, "int64")
        return None, {"name": np.empty(0, object), "last_ts": none, "last_value": np.empty(0), "seen_ts": none}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("arrival", kind="stable")
        codes, names = pd.factorize(batch["series"].to_numpy(dtype=object))
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        ts = batch["micros"].to_numpy(dtype="int64")[order]
        value = batch["value"].to_numpy(dtype="float64")[order]
        arrival = batch["arrival"].to_numpy(dtype="int64")[order]
        dated, firsts = ts != NO_TIME, _firsts(codes)

        timer, clock = self._read_clock()
        at = pd.Index(clock["name"]).get_indexer(names)
        known = at >= 0
        seen = np.full(len(names), NO_TIME)
        seen[known] = clock["seen_ts"][at[known]]
        before = _before(ts, firsts, seen[codes])
        late = dated & (before != NO_TIME) & (ts <= before)

        # A new series without a time has nothing to keep.
        new = ~known & (np.bincount(codes[dated], minlength=len(names)) > 0)
        newest = ts[np.append(firsts[1:], True)]
        clock["seen_ts"] = clock["seen_ts"].copy()
        clock["seen_ts"][at[known]] = newest[known]
        clock = {
            "name": np.concatenate([clock["name"], names[new]]),
            "last_ts": np.concatenate([clock["last_ts"], np.full(new.sum(), NO_TIME)]),
            "last_value": np.concatenate([clock["last_value"], np.full(new.sum(), np.nan)]),
            "seen_ts": np.concatenate([clock["seen_ts"], newest[new]]),
        }
        if dated.any():
            self._wait(names, codes[dated], ts[dated], value[dated], arrival[dated], late[dated])
            due = int(_millis(ts[dated].min()))
            if timer is None or due < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
                timer = due
        if len(clock["name"]):
            self.clock.update((timer, _packed(**clock)))
        if not dated.all():  # a reading without a time has no place in the order
            left = ~dated
            nothing = np.full(left.sum(), NO_TIME), np.full(left.sum(), np.nan)
            yield self._rows(names[codes[left]], ts[left], value[left], arrival[left], *nothing, late[left])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, clock = self._read_clock()
        names, last_ts, last_value = clock["name"], clock["last_ts"].copy(), clock["last_value"].copy()
        codes, ts, value, arrival, late = self._waiting(pd.Index(names))
        due = _millis(ts) <= now
        # Those that had nothing to wait for and were silent for the whole expiry go.
        idle = np.bincount(codes, minlength=len(names)) == 0
        kept = ~idle | (_millis(last_ts) + self.expiry_ms > now)

        rest = [part[~due] for part in (codes, ts, value, arrival, late)]
        if due.any():
            # The stable sort leaves readings of one time and arrival number in the order they came in.
            order = np.lexsort((arrival[due], ts[due], codes[due]))
            of, t, v, a, out_of_order = (part[due][order] for part in (codes, ts, value, arrival, late))
            firsts = _firsts(of)
            yield self._rows(names[of], t, v, a, _before(t, firsts, last_ts[of]), _before(v, firsts, last_value[of]), out_of_order)
            ends = np.append(firsts[1:], True)
            last_ts[of[ends]], last_value[of[ends]] = t[ends], v[ends]
            self.waiting.clear()
            if len(rest[0]):
                self._wait(names, *rest)

        if not kept.any():
            self.clock.clear()
            return
        waits = np.bincount(rest[0], minlength=len(names)) > 0
        timer = int(np.concatenate([_millis(rest[1]), _millis(last_ts[kept & ~waits]) + self.expiry_ms]).min())
        timer += timer == expiredTimerInfo.getExpiryTimeInMs()  # Spark takes away the timer that ran out after this call
        self.handle.registerTimer(timer)
        columns = {"name": names, "last_ts": last_ts, "last_value": last_value, "seen_ts": clock["seen_ts"]}
        self.clock.update((timer, _packed(**{name: column[kept] for name, column in columns.items()})))

    def _wait(self, names, codes, ts, value, arrival, late) -> None:
        used, codes = np.unique(codes, return_inverse=True)
        readings = _packed(code=codes, ts=ts, value=value, arrival=arrival, late=late)
        self.waiting.appendValue((_packed(name=names[used]), readings))

    def _waiting(self, index: pd.Index) -> list[np.ndarray]:
        """The waiting readings: place of the series in the clock, ts, value, arrival, late."""
        parts = []
        for names, readings in self.waiting.get():
            part = _unpacked(readings)
            part["code"] = index.get_indexer(_unpacked(names)["name"])[part["code"]]
            parts.append(part)
        kinds = {"code": "int64", "ts": "int64", "value": "float64", "arrival": "int64", "late": "bool"}
        return [np.concatenate([np.empty(0, kind), *(part[name] for part in parts)]) for name, kind in kinds.items()]

    def _rows(self, series, ts, value, arrival, prev_ts, prev_value, out_of_order) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "series": series,
                "ts": pd.Series(ts.view("datetime64[us]")).dt.tz_localize("UTC"),
                "value": value,
                "arrival": pd.arrays.IntegerArray(arrival, arrival == NO_ARRIVAL),
                "prev_ts": pd.Series(prev_ts.view("datetime64[us]")).dt.tz_localize("UTC"),
                "prev_value": prev_value,
                "step": value - prev_value,
                "out_of_order": out_of_order,
            }
        )


def ordered_steps(
    stream: DataFrame,
    keys: Sequence[str] = SERIES,
    ts: str = "ts",
    value: str = "value",
    arrival: str = "ingest_seq",
    lateness: str = "1 hour",
    expiry_s: int = EXPIRY_S,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Each reading, once it is final, with the reading before it in time (prev_ts, prev_value, step).

    ``out_of_order``: its time does not lie after that of the series' previous arrival. Rows of one
    micro-batch are taken in the order of ``arrival``, and micro-batches in their own order.
    A checkpoint keeps its ``buckets``; clusters of more cores than that take more.
    """
    keyed = T.StructType([T.StructField(k, stream.schema[k].dataType) for k in keys])
    own = stream.select(
        F.to_json(F.struct(*keys), KEY_TEXT).alias("series"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"),
        F.coalesce(F.col(arrival).cast("long"), F.lit(NO_ARRIVAL)).alias("arrival"),
    )
    own = own.withColumns(
        {"bucket": F.pmod(F.xxhash64("series"), F.lit(buckets)).cast("int"), "micros": F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME))}
    )
    steps = (
        own.withWatermark("ts", lateness)
        .groupBy("bucket")
        .transformWithStateInPandas(
            TimeOrder(expiry_s), outputStructType=f"series string, {STEP_FIELDS}", outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts"
        )
    )
    return steps.withColumn("series", F.from_json("series", keyed, KEY_TEXT)).select("series.*", *[f for f in steps.columns if f != "series"])


def stream_order_checks(stream: DataFrame, keys: Sequence[str] = SERIES, **options) -> DataFrame:
    """Readings with ``qc_flags``: the counter fell against the time before, arrived out of order.

    For the readings within the lateness this is the batch rules' result over all of them.
    """
    return ordered_steps(stream, keys, **options).withColumn(
        "qc_flags",
        F.array_compact(
            F.array(
                F.when(F.col("step") < 0, F.lit(FLAG_MONOTONIC)),
                F.when(F.col("out_of_order"), F.lit(FLAG_NOT_CHRONOLOGICAL)),
            )
        ),
    )


def stream_daily_drop(
    readings: DataFrame,
    weather: DataFrame,
    keys: Sequence[str] = ("plant", "device"),
    plant: str = "plant",
    ts: str = "ts",
    irradiance: str = "irradiance",
    interval: str = "15 minutes",
    lateness: str = "1 hour",
    zone: str = "UTC",
    **options,
) -> DataFrame:
    """The daily-drop rule on two streams: falls within a local day, joined with the slot's irradiance.

    The readings come out in time order; a fall waits for its plant's irradiance of the slot (the
    largest of the stations) until both watermarks have passed it. ``daily_drop`` is null where
    none came by then. Readings that did not fall wait for nothing.
    """
    steps = ordered_steps(readings, keys, ts, lateness=lateness, **options)

    def local_day(name: str):
        return F.to_date(F.from_utc_timestamp(name, zone))

    steps = steps.withColumn("fell", F.coalesce((F.col("step") < 0) & (local_day("ts") == local_day("prev_ts")), F.lit(False)))
    # One event-time column a side: the slot. The time itself goes on as a plain value.
    steps = steps.select(
        *keys, F.timestamp_micros(F.unix_micros("ts")).alias("at"), "value", "arrival", "fell", F.window("ts", interval).alias("slot")
    )
    sun = (
        weather.where(F.col(irradiance).isNotNull())
        .select(F.col(plant).alias("sun_plant"), F.col(ts).cast("timestamp").alias("sun_ts"), F.col(irradiance).alias("g"))
        .withWatermark("sun_ts", lateness)
        .groupBy("sun_plant", F.window("sun_ts", interval).alias("sun_slot"))
        .agg(F.max("g").alias("g"))
    )
    met = (F.col(plant) == F.col("sun_plant")) & (F.col("slot") == F.col("sun_slot")) & F.col("fell")
    judged = steps.join(sun, met, "leftOuter")
    drop = F.when(~F.col("fell"), F.lit(False)).otherwise(F.col("g") > 0)
    return judged.select(
        *keys, F.col("at").alias("ts"), "value", "arrival", drop.alias("daily_drop"), F.when(drop, F.lit(FLAG_DAILY_DROP)).alias("qc_flag")
    )


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that came later than the lateness, over the progress reports the query still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
