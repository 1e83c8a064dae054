"""The job queue as a log of events: states, progress, resuming, retries and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.lineage import checkpoint

#: States of a job.
STATES = ("pending", "running", "paused", "done", "failed", "cancelled")
OPEN = ("pending", "running", "paused")
THROTTLE_S, OLD_RATE = 0.5, 0.7
DISK_BYTES = 16 << 30


def latest(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of each key."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def recovered(state: Column) -> Column:
    """A state after a restart: what ran, or isn't known, waits again."""
    return F.when(state.isin(*[s for s in STATES if s != "running"]), state).otherwise("pending")


def next_pending(jobs: DataFrame) -> DataFrame:
    """The first waiting job in list order."""
    return jobs.where("state = 'pending'").orderBy("pos").limit(1)


def resume(pages: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that aren't done yet."""
    return pages.join(done, keys, "left_anti")


def totals(pages: DataFrame, key: str) -> DataFrame:
    """Pages done, warnings and seconds of each job."""
    return pages.groupBy(key).agg(F.count("*").alias("pages_done"), F.sum("warnings").alias("warnings"), F.sum("seconds").alias("seconds"))


def seconds_left(state: Column, seconds: Column, done: Column, total: Column) -> Column:
    """Seconds that an open job still needs at its speed so far; null where that can't be told."""
    return F.when(state.isin(*OPEN) & (done > 0) & (seconds > 0) & (total > done), seconds / done * (total - done))


def queue_summary(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("state").isin("pending", "paused")).alias("waiting"), F.count_if(F.col("state") == "done").alias("done"))


def reorder(jobs: DataFrame, order: DataFrame) -> DataFrame:
    """Jobs in a new order: those listed (id, ord) first, the others as they were; unknown ids don't count."""
    joined = jobs.join(order, "id", "left")
    ranked = F.row_number().over(W.orderBy(F.col("ord").isNull(), "ord", "pos")) - 1
    return joined.withColumn("pos", ranked).drop("ord")


def interrupt(stopping: Column, cancelled: Column, paused: Column) -> Column:
    """The state of a job that was interrupted."""
    return F.when(stopping, "pending").when(cancelled, "cancelled").when(paused, "paused")


def outcome(attempts: Column) -> Column:
    """What the retry rules make of a job's attempts (an array of result names in order).

    Out of memory is tried once more in the fast mode, a worker that died is started again once a job; any other
    failure, or a second of a kind, fails the job.
    """
    start = F.struct(F.lit("running").alias("state"), F.lit("asked").alias("mode"), F.lit(0).alias("deaths"), F.lit(False).alias("reduced"))

    def step(s: Column, x: Column) -> Column:
        def to(state: str, mode: Column, deaths: Column, reduced: Column) -> Column:
            return F.struct(F.lit(state).alias("state"), mode.alias("mode"), deaths.alias("deaths"), reduced.alias("reduced"))

        again = (
            F.when(x == "ok", to("done", s["mode"], s["deaths"], s["reduced"]))
            .when((x == "oom") & ~s["reduced"], to("running", F.lit("fast"), s["deaths"], F.lit(True)))
            .when((x == "died") & (s["deaths"] == 0), to("running", s["mode"], s["deaths"] + 1, s["reduced"]))
            .otherwise(to("failed", s["mode"], s["deaths"], s["reduced"]))
        )
        return F.when(s["state"] == "running", again).otherwise(s)

    return F.aggregate(attempts, start, step)


def page_outcome(attempts: Column, mode: Column) -> Column:
    """What the rules for single pages make of a page's attempts in a mode: state, mode and whether it warns of memory.

    A worker that died is started again once in a mode; out of memory is tried once more, only from `quality`, in the
    fast mode, where the worker may be started again once more.
    """
    start = F.struct(F.lit("running").alias("state"), mode.alias("mode"), F.lit(False).alias("again"), F.lit(False).alias("reduced"))

    def step(s: Column, x: Column) -> Column:
        def to(state: str, now: Column, again: Column, reduced: Column) -> Column:
            return F.struct(F.lit(state).alias("state"), now.alias("mode"), again.alias("again"), reduced.alias("reduced"))

        after = (
            F.when(x == "ok", to("done", s["mode"], s["again"], s["reduced"]))
            .when((x == "oom") & (s["mode"] == "quality"), to("running", F.lit("fast"), F.lit(False), F.lit(True)))
            .when((x == "died") & ~s["again"], to("running", s["mode"], F.lit(True), s["reduced"]))
            .otherwise(to("failed", s["mode"], s["again"], s["reduced"]))
        )
        return F.when(s["state"] == "running", after).otherwise(s)

    return F.aggregate(attempts, start, step, lambda s: F.struct(s["state"].alias("state"), s["mode"].alias("mode"), s["reduced"].alias("reduced")))


def collapse_progress(events: DataFrame, key: str, stage: str, state: str, order: list[str]) -> DataFrame:
    """Of consecutive progress events of a stage only the last; all other events."""
    line = W.partitionBy(key).orderBy(*order)
    goes_on = (F.col(state) == "progress") & (F.lead(state).over(line) == "progress") & (F.lead(stage).over(line) == F.col(stage))
    return events.withColumn("__on", F.coalesce(goes_on, F.lit(False))).where("NOT __on").drop("__on")


def pieces(events: DataFrame, order: list[str], number: int | None = None) -> DataFrame:
    """Events with `piece`: runs of about equal size in an order of all events, equal rows in one.

    There are `number` of them, or as many as a shuffle has partitions, small ones being put together. The numbers are checkpointed, as what samples the order may cut it elsewhere when it is done again.
    """
    ranged = events.repartitionByRange(number, *order) if number else events.repartitionByRange(*order)
    return checkpoint(ranged.withColumn("piece", F.spark_partition_id()))


def smoothed_rate(events: DataFrame, key: str, stage: str, time: str, done: str, number: int | None = None) -> DataFrame:
    """The smoothed speed of each key after its last event, from event times in seconds and amounts done.

    A change of stage, or an amount that shrinks, begins anew; the first speed counts whole.

    It is a scan: what an event does to a speed is a map that takes nothing (0) to `zero`, and any other speed to `factor` *
    speed + `more`; maps of events one after the other make one of the same kind. So a key's events are cut into pieces,
    each is folded to its map by a task of its own, and the pieces' maps are put together, as many as there are
    pieces at most.
    """
    rows = events.select(F.col(key).alias("key"), F.col(time).alias("t"), F.col(stage).alias("s"), F.col(done).cast("double").alias("d"))
    cut = pieces(rows, ["key", "t", "s", "d"], number)
    line = F.array_sort(F.collect_list(F.struct("t", "s", "d")))

    def map_of(a: Column, x: Column) -> tuple[Column, Column, Column]:
        """zero, factor and more of the event x after a."""
        goes_on = F.coalesce((a["s"] == x["s"]) & (x["d"] >= a["d"]) & (x["t"] > a["t"]), F.lit(False))
        now = (x["d"] - a["d"]) / (x["t"] - a["t"])
        nil = F.lit(0.0)
        return F.when(goes_on, now).otherwise(nil), F.when(goes_on, F.lit(OLD_RATE)).otherwise(nil), F.when(goes_on, now * (1 - OLD_RATE)).otherwise(nil)

    def applied(speed: Column, zero: Column, factor: Column, more: Column) -> Column:
        return F.when(speed == 0, zero).otherwise(factor * speed + more)

    def step(a: Column, x: Column) -> Column:
        zero, factor, more = map_of(a, x)
        # where the map so far is a constant, what follows is applied to it; a speed is never below 0
        fixed = a["factor"] == 0
        both = F.struct(F.when(fixed, 0.0).otherwise(factor * a["factor"]).alias("factor"), F.when(fixed, applied(a["more"], zero, factor, more)).otherwise(factor * a["more"] + more).alias("more"))
        # a beginning anew forgets all before it
        return F.struct(x["t"].alias("t"), x["s"].alias("s"), x["d"].alias("d"), applied(a["zero"], zero, factor, more).alias("zero"), both["factor"].alias("factor"), both["more"].alias("more"))

    first = F.struct(F.col("line")[0]["t"].alias("t"), F.col("line")[0]["s"].alias("s"), F.col("line")[0]["d"].alias("d"), F.lit(0.0).alias("zero"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("more"))
    folded = cut.groupBy("key", "piece").agg(line.alias("line"))
    mapped = folded.select("key", "piece", F.col("line")[0].alias("first"), F.aggregate(F.slice("line", F.lit(2), F.size("line")), first, step).alias("last"))
    ordered = F.array_sort(F.collect_list(F.struct("piece", "first", "last")))
    start = F.struct(F.lit(None).cast(rows.schema["t"].dataType).alias("t"), F.lit(None).cast(rows.schema["s"].dataType).alias("s"), F.lit(None).cast("double").alias("d"), F.lit(0.0).alias("rate"))

    def joined(a: Column, piece: Column) -> Column:
        begun = applied(a["rate"], *map_of(a, piece["first"]))
        last = piece["last"]
        return F.struct(last["t"].alias("t"), last["s"].alias("s"), last["d"].alias("d"), applied(begun, last["zero"], last["factor"], last["more"]).alias("rate"))

    return mapped.groupBy("key").agg(ordered.alias("all")).select(F.col("key").alias(key), F.aggregate("all", start, joined, lambda a: a["rate"]).alias("rate"))


def throttle(events: DataFrame, key: str, time: str, value: str, gap: float = THROTTLE_S) -> DataFrame:
    """Events that a reporter sends: the first, then each at least `gap` after the last one sent with another value."""
    line = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))))
    kind = events.select(F.col(time).alias("t"), F.col(value).alias("v")).schema
    none = F.array().cast(f"array<struct<t:{kind['t'].dataType.simpleString()},v:{kind['v'].dataType.simpleString()}>>")

    def step(sent: Column, x: Column) -> Column:
        last = F.try_element_at(sent, F.lit(-1))
        due = (F.size(sent) == 0) | ((x["t"] - last["t"] >= gap) & (x["v"] != last["v"]))
        return F.when(due, F.concat(sent, F.array(x))).otherwise(sent)

    return events.groupBy(key).agg(F.aggregate(line, none, step).alias("sent")).select(key, F.explode("sent").alias("x")).select(key, F.col("x.t").alias(time), F.col("x.v").alias(value))


def correlated(events: DataFrame, request: str = "id") -> DataFrame:
    """For each request its terminal event: a result, an error, or `timeout` if none came."""
    ends = F.min_by(F.when(F.col("event").isin("result", "error"), F.col("event")), F.when(F.col("event").isin("result", "error"), F.col("seq")))
    return events.groupBy(request).agg(F.coalesce(ends, F.lit("timeout")).alias("outcome"), F.count_if(F.col("event") == "progress").alias("progress"))


def idle_sessions(events: DataFrame, key: str, time: str, minutes: int) -> DataFrame:
    """Spans of activity of each key that an idle stop after so many minutes would end."""
    return events.groupBy(key, F.session_window(time, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("began"), F.col("w.end").alias("stops"), "events")


def languages_status(manifest: DataFrame, installed: DataFrame, states: DataFrame) -> DataFrame:
    """Each language of a manifest (lang, size) with its size, whether it is installed, and its last job state."""
    sums = manifest.groupBy("lang").agg(F.sum("size").alias("size"))
    return sums.join(installed.select("lang", F.lit(True).alias("installed")), "lang", "left").join(states.select("lang", "state"), "lang", "left").withColumn("installed", F.coalesce("installed", F.lit(False)))


def free_bytes_needed(present: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(DISK_BYTES) - present)


def job_view(jobs: DataFrame) -> DataFrame:
    """Columns that a list of jobs shows: file name and time left."""
    return jobs.withColumn("name", F.regexp_extract("source", r"[^/\\]+$", 0)).withColumn("eta", seconds_left(F.col("state"), F.col("seconds"), F.col("pages_done"), F.col("pages_total")))


def merged_outputs(jobs: DataFrame, added: DataFrame) -> DataFrame:
    """Jobs with more outputs (id, outputs map): a format that comes again takes the new path."""
    more = added.select("id", F.col("outputs").alias("__more"))
    joined = jobs.join(more, "id", "left")
    old = F.map_filter("outputs", lambda k, _: ~F.map_contains_key("__more", k))
    return joined.withColumn("outputs", F.when(F.col("__more").isNull(), F.col("outputs")).otherwise(F.map_concat(F.coalesce(old, F.create_map().cast("map<string,string>")), F.col("__more")))).drop("__more")


def added_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with new ones (id, source, error) at the end of the list; one that can't be read is failed at once."""
    last = jobs.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("__last"))
    placed = new.crossJoin(F.broadcast(last)).withColumn("pos", F.row_number().over(W.orderBy("id")) + F.col("__last"))
    rows = placed.select("id", "source", F.when(F.col("error").isNull(), "pending").otherwise("failed").alias("state"), "error", "pos")
    return jobs.unionByName(rows, allowMissingColumns=True)


def without_finished(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("state").isin("done", "failed", "cancelled"))
