"""Incremental versions of the recurring jobs, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.shared import scratch


def follow(spark: SparkSession, path: str, schema, form: str = "json", files: int | None = None) -> DataFrame:
    """A growing folder as a stream; at most ``files`` new files a batch."""
    r = spark.readStream.schema(schema).format(form)
    return (r.option("maxFilesPerTrigger", files) if files else r).load(path)


def once_each(stream: DataFrame, key: str, at: str | None = None, late: str = "1 day") -> DataFrame:
    """Each key once: over all time, or with bounded state within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if at else stream.dropDuplicates([key])


def run_available(stream: DataFrame, into: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is there now and stop; a later call with the same checkpoint goes on from here."""
    stream.writeStream.outputMode(mode).foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run over what is there and give the emitted rows back as a table in the shared folder.

    Each micro-batch has a folder of its own, which a repeated batch replaces. In
    complete and update mode the last batch that holds a row's values counts: the
    rows carry ``_batch``.
    """
    spark = stream.sparkSession
    out = scratch(spark, "stream-out")
    run_available(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/_batch={n}"), scratch(spark, "stream-checkpoint"), mode)
    return spark.read.schema(stream.schema.add("_batch", "long")).parquet(out)


def windowed(stream: DataFrame, at: str, size: str, keys: list[str], value: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window: tumbling, or sliding with a slide."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key with their event counts."""
    g = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: What operators with state of their own and timers need.
OWN_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def own_state(spark: SparkSession):
    """The session with the state store that such operators need."""
    before = {k: spark.conf.get(k, None) for k in OWN_STATE}
    for k, v in OWN_STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def leases(stream: DataFrame, who: str = "who", item: str = "item", at: str = "at", minutes: int = 20, late: str = "1 minute", done: str | None = None) -> DataFrame:
    """Leases by labeller, each with what happens to it: (who, item, event, at, expires_at).

    A request of a labeller who holds nothing is `granted` its item for so many minutes. One
    who holds an item gets that again (`kept`), whatever was asked for: nobody has two at a
    time. Rows where the boolean column ``done`` holds end the lease (`done`). A lease that
    runs out is `expired` at its end, by an event-time timer once the watermark has passed,
    without a further request; its state is then gone, so that there is state for open
    leases only. Rows more than ``late`` behind are not taken up. Run it under ``own_state``.
    """
    from pyspark.sql.streaming import StatefulProcessor

    kind, thing = stream.schema[who].dataType.simpleString(), stream.schema[item].dataType.simpleString()
    names = ["who", "item", "event", "at", "expires_at"]
    length = pd.Timedelta(minutes=minutes)
    plain = int if thing in ("smallint", "int", "bigint") else lambda x: x  # a null in a batch makes its whole numbers floats

    class Leases(StatefulProcessor):  # here, so that it travels to the executors by value
        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", f"item {thing}, until bigint")

        def close(self) -> None:
            pass

        def _end(self, key: tuple, event: str, when: pd.Timestamp) -> tuple:
            held, until = self.open.get()
            self.handle.deleteTimer(-(-until // 1000))
            self.open.clear()
            return key[0], held, event, when, pd.Timestamp(until, unit="us")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            out = []
            for row in pd.concat(list(rows)).sort_values([at, item]).to_dict("records"):
                t = row[at]
                if self.open.exists() and t >= (until := pd.Timestamp(self.open.get()[1], unit="us")):
                    out.append(self._end(key, "expired", until))
                if done and row[done]:
                    if self.open.exists():
                        out.append(self._end(key, "done", t))
                elif self.open.exists():
                    held, until = self.open.get()
                    out.append((key[0], held, "kept", t, pd.Timestamp(until, unit="us")))
                else:
                    until = int((t + length).value // 1000)
                    asked = plain(row[item])
                    self.open.update((asked, until))
                    self.handle.registerTimer(-(-until // 1000))
                    out.append((key[0], asked, "granted", t, t + length))
            yield pd.DataFrame(out, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.open.exists():
                yield pd.DataFrame([self._end(key, "expired", pd.Timestamp(self.open.get()[1], unit="us"))], columns=names)

    shape = f"who {kind}, item {thing}, event string, at timestamp, expires_at timestamp"
    return stream.withWatermark(at, late).groupBy(who).transformWithStateInPandas(Leases(), shape, "append", "EventTime")


def snapshot(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A running aggregate whose last state is the materialised snapshot."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))


def latest(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """The last emitted row of each key from update-mode output."""
    rest = [c for c in emitted.columns if c not in (*keys, "_batch")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def derived(changes: DataFrame, key: str, seq: str, columns: dict) -> DataFrame:
    """Each key's latest row by seq with its derived columns, computed anew whenever the row changes (update mode)."""
    rest = [c for c in changes.columns if c not in (key, seq)]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*").withColumns(columns)


def device_slots(stream: DataFrame, who: str = "who", device: str = "device", at: str = "at", most: int = 2, days: int = 30, late: str = "1 day") -> DataFrame:
    """Requests with whether their device has a slot: (who, device, at, allowed), batch by batch in order of time.

    A known device is allowed and seen anew. A new one first frees the slots of devices
    not seen for ``days``, then takes a slot if one is free. The state of an account is
    its slots, at most ``most``, however many requests it makes; once the watermark says that
    none of its devices has been seen for ``days``, its state is released, which changes no answer.
    """
    kind, thing = stream.schema[who].dataType.simpleString(), stream.schema[device].dataType.simpleString()
    names = ["who", "device", "at", "allowed"]

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        slots = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values([at, device])
        out = []
        for t, x in zip(rows[at], rows[device]):
            if x not in slots:
                slots = {k: seen for k, seen in slots.items() if pd.Timestamp(seen) >= t - pd.Timedelta(days=days)}
            ok = x in slots or len(slots) < most
            if ok:
                slots[x] = t.to_pydatetime()
            out.append((key[0], x, t, ok))
        over = int((pd.Timestamp(max(slots.values())) + pd.Timedelta(days=days)).value // 1_000_000) + 1
        if over > state.getCurrentWatermarkMs():
            state.update((list(slots), list(slots.values())))
            state.setTimeoutTimestamp(over)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    told = f"who {kind}, device {thing}, at timestamp, allowed boolean"
    return stream.withWatermark(at, late).groupBy(who).applyInPandasWithState(admit, told, f"devices array<{thing}>, seen array<timestamp>", "append", "EventTimeTimeout")


def edits_in_time(answers: DataFrame, edits: DataFrame, keys: list[str], at: str = "at", hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Edits that come within so many hours of the answer they change: the edits' columns and answered_at.

    A join of two streams by key and a range of time; watermarks let both sides forget what
    can no longer meet. An edit before its answer, or too late, changes nothing.
    """
    a = answers.withWatermark(at, late).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(at).alias("answered_at"))
    e = edits.withWatermark(at, late)
    same = [F.col(f"_{k}") == F.col(k) for k in keys]
    near = (F.col(at) >= F.col("answered_at")) & (F.col(at) <= F.col("answered_at") + F.make_dt_interval(hours=F.lit(hours)))
    return e.join(a, [*same, near]).drop(*(f"_{k}" for k in keys))
