"""Rows of a key in the order of their event time, whatever micro-batches they came in.

Keys are dealt by hash to buckets, which are the groups of the stateful operator. Rows wait in a bucket's state until the
watermark has passed their time; then those of all its keys are taken in order, together with the keys' states, as one table, so
that a key costs rows and not calls; a batch writes anew the state of the buckets that it touches. So a replay that cuts the input
into other batches gives the same results. A key of which nothing came for a while of event time is forgotten, which bounds the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of a stateful operator. A bucket's state grows with the keys over this number.
BUCKETS = 512
#: Stores of a stream's state, or twice the cores where that is more.
STORES = 32
#: No time, in milliseconds.
NEVER = 1 << 62
#: (rows in order, rows of state), both with `run`, to (new rows of state with `run`, rows of the result).
Fold = Callable[[pd.DataFrame, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]]


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as one value of state, in Arrow's format: a call and a value for a table, not for each row."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.BufferOutputStream() as sink:
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()


class _InOrder:
    """The function of a bucket's rows and state, which is (chunks of rows that wait, chunks of state)."""

    def __init__(self, keys: list[str], columns: list[str], state_columns: list[str], whole: list[str], fold: Fold, forget_ms: int):
        self.keys, self.columns, self.state_columns, self.whole, self.fold, self.forget_ms = keys, columns, state_columns, whole, fold, forget_ms

    def _table(self, chunks: list[bytes], columns: list[str]) -> pd.DataFrame:
        parts = [pa.ipc.open_stream(chunk).read_pandas() for chunk in chunks]
        table = pd.concat(parts, ignore_index=True)[columns] if parts else pd.DataFrame(columns=columns)
        return table.astype({k: "Int64" for k in self.whole})  # keys of whole numbers stay whole beside nulls

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, known, wake = state.get if state.exists else ([], [], NEVER)
        pending, known, now = list(pending), list(known), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            new = pd.concat(list(batches))[self.columns]
            pending.append(_packed(new))
            wake = min(wake, int(new["time_us"].min() // 1000) + 1)
        if wake <= now:
            waiting, last, out = self._taken(self._table(pending, self.columns), self._table(known, self.state_columns), now)
            pending, known = ([_packed(rows)] if len(rows) else [] for rows in (waiting, last))
            times = [(waiting["time_us"], 1), (last["last_us"], self.forget_ms + 1)]
            wake = min((int(t.min() // 1000) + more for t, more in times if len(t)), default=NEVER)
            if len(out):
                yield out
        if pending or known:
            state.update((pending, known, wake))
            state.setTimeoutTimestamp(max(wake, now + 1))
        else:
            state.remove()

    def _taken(self, waiting: pd.DataFrame, last: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
        """(rows that wait on, state, result) once the watermark is at `now` milliseconds."""
        ready = waiting["time_us"] <= now * 1000
        due = waiting[ready].sort_values(self.columns, kind="stable", ignore_index=True)
        last = last.astype({"last_us": "int64"})
        fresh = last["last_us"] // 1000 + self.forget_ms + 1 > now
        if not len(due):
            return waiting, last[fresh], due[:0]
        number = pd.concat([last[self.keys], due[self.keys]]).groupby(self.keys, dropna=False, sort=False).ngroup().to_numpy()
        last["key"], due["key"] = number[: len(last)], number[len(last) :]
        due = due.sort_values("key", kind="stable", ignore_index=True)
        # A run is what a key's rows are between two times of being forgotten; the first may go on from the state.
        known = due["key"].map(last.drop_duplicates("key").set_index("key")["last_us"])
        before = due.groupby("key")["time_us"].shift(1).fillna(known)
        begins = before.isna() | (due["time_us"] > (before // 1000 + self.forget_ms + 1) * 1000)
        goes_on = ~begins & (due["key"] != due["key"].shift(1))
        due["run"] = (begins | goes_on).cumsum()
        run = due.loc[goes_on].set_index("key")["run"]
        seen = last.assign(run=last["key"].map(run)).dropna(subset="run").astype({"run": "int64"})
        state, out = self.fold(due, seen)
        newest = due.groupby("run").tail(1).drop_duplicates("key", keep="last").set_index("run")
        state = state[state["run"].isin(newest.index)]
        own = newest.loc[state["run"], [*self.keys, "time_us"]].rename(columns={"time_us": "last_us"}).reset_index(drop=True)
        kept = pd.concat([own, state.drop(columns="run").reset_index(drop=True)], axis=1)[self.state_columns]
        others = last.loc[fresh & ~last["key"].isin(due["key"]), self.state_columns]
        state = pd.concat([others, kept]) if len(others) else kept
        return waiting[~ready], state[state["last_us"] // 1000 + self.forget_ms + 1 > now], out


def in_order(rows: DataFrame, keys: list[str], time: str, columns: list[str], state: str, out: str, fold: Fold, watermark: str, forget: float, buckets: int = BUCKETS) -> DataFrame:
    """A streaming frame of what `fold` gives for the rows of each key, taken in the order of `time` and then of `columns`.

    `state` and `out` are schemas without the keys. The fold's rows have the keys, time_us (microseconds), `columns` and `run`, the
    number of a key's stretch of rows; it gives the rows of state that each run leaves, with `run`, and those of `out` with the keys.
    Keys of which nothing came for `forget` seconds of event time after their last row lose their state.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    timed = rows.withWatermark(time, watermark).select(bucket, *keys, time, F.unix_micros(F.col(time)).alias("time_us"), *columns)
    own = ["time_us", *columns, *keys]
    whole = [k for k in keys if isinstance(timed.schema[k].dataType, T.IntegralType)]
    result = T.StructType([rows.schema[k] for k in keys] + list(T.StructType.fromDDL(out)))
    state_columns = [*keys, "last_us", *T.StructType.fromDDL(state).names]
    step = _InOrder(keys, own, state_columns, whole, fold, int(forget * 1000))

    def taken(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return step(key, batches, state)

    kept = "pending array<binary>, known array<binary>, wake long"
    return timed.groupBy("bucket").applyInPandasWithState(taken, result, kept, "append", GroupStateTimeout.EventTimeTimeout)


def start_stateful(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a stream whose state lies in no more stores than its cores keep busy.

    A store is opened and committed in every batch, whatever it holds. A stream keeps the number that its checkpoint began with.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), max(STORES, 2 * spark.sparkContext.defaultParallelism)))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, before)
