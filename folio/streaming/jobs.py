"""The job layer as streams: protocol lines in, pages written once, latest states and rates kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.operators.jobs import OLD_RATE
from folio.sources.protocol import decode


#: Folders by which pages that are written are dealt, and the column that names them.
PARTS, PART = 256, "part"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder).withColumnRenamed("value", "line")


def decoded_lines(lines: DataFrame) -> DataFrame:
    return decode(lines)


def write_pages_once(pages: DataFrame, folder: str, checkpoint: str, keys: list[str]):
    """Append pages to a Parquet folder, each key once: what is there, or comes again, is left out.

    A batch that is run again after a failure finds its own pages and adds none. Pages lie in folders by a hash of the key,
    and a batch reads those of its own keys only.
    """
    spark, schema = pages.sparkSession, pages.schema

    def add(batch: DataFrame, _: int) -> None:
        placed = batch.dropDuplicates(keys).withColumn(PART, F.pmod(F.hash(*keys), F.lit(PARTS)))
        parts = [r[PART] for r in placed.select(PART).distinct().collect()]  # PARTS at most
        try:
            done = spark.read.schema(f"{schema.toDDL()}, {PART} int").parquet(folder).where(F.col(PART).isin(*parts)).select(*keys)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = batch.select(*keys).limit(0)
        placed.join(done, keys, "left_anti").write.mode("append").partitionBy(PART).parquet(folder)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)


class FirstOfKey(StatefulProcessor):
    """Lets the first row of each key through; what comes again, in whatever batch, is left out until the key is forgotten."""

    def __init__(self, columns: list[str], forget_ms: int | None) -> None:
        self.columns, self.forget_ms = columns, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.seen.exists():
            return
        first = pd.concat(list(rows))[self.columns]
        self.seen.update((True,))
        # of rows that come together the least counts, so that a batch that is run again gives the same one
        yield first.sort_values(self.columns, na_position="last").head(1)

    def close(self) -> None:
        pass


def first_pages(pages: DataFrame, keys: list[str], forget_hours: float | None = None) -> DataFrame:
    """Each page once, by state kept for its key: nothing that was written is read again.

    With `forget_hours`, a key is forgotten that long after its page came, so that the state follows what is in work.
    """
    forget = None if forget_hours is None else int(forget_hours * 3_600_000)
    return pages.groupBy(*keys).transformWithStateInPandas(FirstOfKey(pages.columns, forget), pages.schema, "append", "none" if forget is None else "processingTime")


class IdleStop(StatefulProcessor):
    """Keeps a key's open spans of activity, and gives each one out when event time has passed its end by the idle minutes."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "began long, last long, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        times = pd.concat(list(rows))["time"]
        spans = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        spans += [(t, t, 1) for t in (times.astype("datetime64[ms]").astype("int64"))]
        merged: list[tuple[int, int, int]] = []
        for began, last, events in sorted(spans):  # late events may join two spans
            if merged and began <= merged[-1][1] + self.idle_ms:
                a, b, n = merged.pop()
                merged.append((a, max(b, last), n + events))
            else:
                merged.append((began, last, events))
        self._keep(merged)
        return iter(())

    def _keep(self, spans: list[tuple[int, int, int]]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not spans:
            self.open.clear()
            return
        self.open.put([(int(a), int(b), int(n)) for a, b, n in spans])
        for end in {int(b) + self.idle_ms for _, b, _ in spans}:
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark calls by
        now = timerValues.getCurrentWatermarkInMs()
        spans = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        done = [x for x in spans if x[1] + self.idle_ms <= now]
        self._keep([x for x in spans if x not in done])
        if done:
            ends = [pd.Timestamp(b + self.idle_ms, unit="ms") for _, b, _ in done]
            yield pd.DataFrame({"key": [str(key[0])] * len(done), "began": [pd.Timestamp(a, unit="ms") for a, _, _ in done], "stops": ends, "events": [n for *_, n in done]})

    def close(self) -> None:
        pass


def idle_stops(events: DataFrame, key: str, time: str, minutes: float, late_minutes: float = 0) -> DataFrame:
    """When an engine that is stopped after so many idle minutes would be, as in the batch: key, began, stops and events.

    A span comes out once event time, less `late_minutes` for what comes late, has passed its stop.
    """
    given = events.select(F.col(key).alias("key"), F.col(time).alias("time")).withWatermark("time", f"{late_minutes} minutes")
    return given.groupBy("key").transformWithStateInPandas(IdleStop(int(minutes * 60_000)), "key string, began timestamp, stops timestamp, events long", "append", "eventTime", eventTimeColumnName="stops")


def latest_states(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of each key so far, for output mode `update` or `complete`."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


class SmoothedRate(StatefulProcessor):
    """Keeps (time, stage, done, rate) by key and gives the rate after each batch of events t, s and d."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double, s string, d double, rate double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = self.last.get() if self.last.exists() else None
        for t, s, d in pd.concat(list(rows))[["t", "s", "d"]].sort_values(["t", "s", "d"]).itertuples(index=False):
            rate = 0.0
            if last is not None and last[1] == s and d >= last[2] and t > last[0]:
                now = (d - last[2]) / (t - last[0])
                rate = now if last[3] == 0 else last[3] * OLD_RATE + now * (1 - OLD_RATE)
            last = (float(t), s, float(d), float(rate))
        self.last.update(last)
        yield pd.DataFrame({"key": [str(key[0])], "rate": [last[3]]})

    def close(self) -> None:
        pass


def smoothed_rates(events: DataFrame, key: str) -> DataFrame:
    """The same speeds as the batch fold, for events (key, t, s, d) that arrive in time order."""
    return events.groupBy(key).transformWithStateInPandas(SmoothedRate(), "key string, rate double", "update", "none")


#: An engine takes page rows and gives recognised rows; see `recorded_engine`.
Engine = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
RESULT = "page string, mode string, text string, seconds double, prefix_tokens int, output_tokens int, hit_token_cap boolean, cancelled boolean, timed_out boolean"


def recognise(pages: DataFrame, engine: Engine) -> DataFrame:
    """Run an engine over pages (page, mode) in batches."""
    return pages.mapInPandas(engine, RESULT)


def recorded_engine(recorded: DataFrame, pages: DataFrame) -> DataFrame:
    """The default engine: outputs recorded before, looked up by page and mode."""
    return pages.join(recorded, ["page", "mode"], "left")
