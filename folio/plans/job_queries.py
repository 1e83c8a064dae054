"""Queries on jobs, protocols, manifests and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import integrity, jobs
from folio.plans.inputs import table
from folio.plans.registry import query
from folio.schema import DOCUMENT
from folio.sources import files, protocol

#: States by event type, the same in both engines.
_STATES = "CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'click' THEN 'running' WHEN event_type = 'view' THEN 'paused' ELSE 'pending' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job log: the user is the job, the type its stage, the time its order."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job"), "event_type", "value", t.alias("t"), "props", F.expr(_STATES).alias("state"))


_LOG = f"log AS (SELECT event_id, user_id AS job, event_type, value, epoch_us(ts) / 1e6 AS t, props, {_STATES} AS state FROM events)"


@query(f"WITH {_LOG}, l AS (SELECT job, arg_max(state, (t, event_id)) AS state FROM log GROUP BY job) SELECT job, state, CASE WHEN state = 'running' THEN 'pending' ELSE state END AS recovered FROM l")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(_events(spark, sf_dir), "job", "state", ["t", "event_id"]).withColumn("recovered", jobs.recovered(F.col("state")))


_TOTALS = f"{_LOG}, totals AS (SELECT job, count(*) AS pages_done, count(*) FILTER (WHERE value > 50) AS warnings, sum(value) AS seconds FROM log GROUP BY job)"


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _events(spark, sf_dir).select("job", F.when(F.col("value") > 50, 1).otherwise(0).alias("warnings"), F.col("value").alias("seconds"))
    return jobs.totals(pages, "job")


@query(f"WITH {_TOTALS} SELECT job, pages_done, CAST(warnings AS BIGINT) AS warnings, round(seconds, 4) AS seconds FROM totals")
def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).withColumn("seconds", F.round("seconds", 4))


@query(f"WITH {_TOTALS}, l AS (SELECT job, arg_max(state, (t, event_id)) AS state FROM log GROUP BY job) SELECT x.job, CASE WHEN l.state IN ('pending', 'running', 'paused') AND seconds > 0 AND pages_done < 2 * pages_done - 1 THEN round(seconds / pages_done * (pages_done - 1), 3) END AS eta FROM totals x JOIN l ON l.job = x.job")
def job_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds left of jobs of which nearly half is done."""
    states = jobs.latest(_events(spark, sf_dir), "job", "state", ["t", "event_id"])
    total = 2 * F.col("pages_done") - 1
    return _totals(spark, sf_dir).join(states, "job").select("job", F.round(jobs.seconds_left(F.col("state"), F.col("seconds"), F.col("pages_done"), total), 3).alias("eta"))


@query("SELECT e.user_id AS job, e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id = e.event_id AND d.event_type = 'click')")
def resume_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir)
    return jobs.resume(log.select("job", "event_id"), log.where("event_type = 'click'").select("job", "event_id"), ["job", "event_id"])


@query(f"WITH {_LOG}, l AS (SELECT job, arg_max(state, (t, event_id)) AS state FROM log GROUP BY job) SELECT count(*) AS total, count(*) FILTER (WHERE state IN ('pending', 'paused')) AS waiting, count(*) FILTER (WHERE state = 'done') AS done FROM l")
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_summary(jobs.latest(_events(spark, sf_dir), "job", "state", ["t", "event_id"]))


_QUEUE = f"{_LOG}, queue AS (SELECT job AS id, arg_max(state, (t, event_id)) AS state, job AS pos FROM log GROUP BY job)"


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their last states; the list's order is that of their ids."""
    return jobs.latest(_events(spark, sf_dir), "job", "state", ["t", "event_id"]).select(F.col("job").alias("id"), "state", F.col("job").alias("pos"))


@query(f"WITH {_QUEUE}, o AS (SELECT *, CASE WHEN id % 7 = 0 THEN -id END AS ord FROM queue) SELECT id, CAST(row_number() OVER (ORDER BY ord IS NULL, ord, pos) - 1 AS INT) AS pos FROM o")
def reordered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh job first, backwards; the order names some that aren't there."""
    given = _queue(spark, sf_dir)
    order = given.where("id % 7 = 0").select("id", (-F.col("id")).alias("ord")).unionByName(given.select((F.col("id") + 1_000_000).alias("id"), F.lit(0).alias("ord")))
    return jobs.reorder(given, order).select("id", "pos")


@query(f"WITH {_QUEUE} SELECT id FROM queue WHERE state = 'pending' ORDER BY pos LIMIT 1")
def next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.next_pending(_queue(spark, sf_dir)).select("id")


_PROGRESS = "CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'progress' END"


@query(f"WITH {_LOG}, e AS (SELECT event_id, job, event_type AS stage, {_PROGRESS} AS s, row_number() OVER (PARTITION BY job ORDER BY t, event_id) AS i FROM log) SELECT a.event_id, a.job FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.job = a.job AND b.i = a.i + 1 AND b.s = 'progress' AND a.s = 'progress' AND b.stage = a.stage)")
def progress_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).withColumn("s", F.expr(_PROGRESS))
    return jobs.collapse_progress(log, "job", "event_type", "s", ["t", "event_id"]).select("event_id", "job")


@query(f"WITH {_LOG} SELECT event_type AS stage, arg_max(event_id, (t, event_id)) AS event_id FROM log GROUP BY event_type")
def stage_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(_events(spark, sf_dir), "event_type", "event_id", ["t", "event_id"]).withColumnRenamed("event_type", "stage")


_WALK = f"{_LOG}, few AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY t, event_type, value) AS i FROM log)"


@query(f"""WITH RECURSIVE {_WALK}, fold AS (SELECT job, i, t, event_type AS s, value AS d, CAST(0 AS DOUBLE) AS rate FROM few WHERE i = 1
UNION ALL SELECT x.job, x.i, x.t, x.event_type, x.value, CASE WHEN f.s = x.event_type AND x.value >= f.d AND x.t > f.t THEN CASE WHEN f.rate = 0 THEN (x.value - f.d) / (x.t - f.t) ELSE f.rate * 0.7 + (x.value - f.d) / (x.t - f.t) * 0.3 END ELSE 0 END FROM fold f JOIN few x ON x.job = f.job AND x.i = f.i + 1)
SELECT job, round(arg_max(rate, i), 9) AS rate FROM fold GROUP BY job""")  # fmt: skip
def smoothed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.smoothed_rate(_events(spark, sf_dir), "job", "event_type", "t", "value").select("job", F.round("rate", 9).alias("rate"))


@query(f"""WITH RECURSIVE {_LOG}, few AS (SELECT job, t, CAST(event_id % 3 AS INT) AS v, row_number() OVER (PARTITION BY job ORDER BY t, event_id % 3) AS i FROM log),
fold AS (SELECT job, i, t, v, t AS last_t, v AS last_v, TRUE AS sent FROM few WHERE i = 1
UNION ALL SELECT x.job, x.i, x.t, x.v, CASE WHEN x.t - f.last_t >= 36000 AND x.v <> f.last_v THEN x.t ELSE f.last_t END, CASE WHEN x.t - f.last_t >= 36000 AND x.v <> f.last_v THEN x.v ELSE f.last_v END, x.t - f.last_t >= 36000 AND x.v <> f.last_v FROM fold f JOIN few x ON x.job = f.job AND x.i = f.i + 1)
SELECT job, count(*) AS n, round(sum(t), 3) AS sum_t FROM fold WHERE sent GROUP BY job""")  # fmt: skip
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).withColumn("v", (F.col("event_id") % 3).cast("int"))
    sent = jobs.throttle(log, "job", "t", "v", gap=36000.0)
    return sent.groupBy("job").agg(F.count("*").alias("n"), F.round(F.sum("t"), 3).alias("sum_t"))


#: The k-th attempt of an event's page, by digits of its number to the base of four.
_TRY = "['ok', 'oom', 'died', 'bad'][CAST(event_id // {} % 4 AS INT) + 1]"
_TRIES = f"e AS (SELECT event_id, event_id % 5 > 1 AS quality, {_TRY.format(1)} AS a, {_TRY.format(4)} AS b, {_TRY.format(16)} AS c, {_TRY.format(64)} AS d FROM events)"


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("ok", "oom", "died", "bad")))
    tries = F.array(*(F.element_at(names, (F.floor(F.col("event_id") / 4**k) % 4).cast("int") + 1) for k in range(4)))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 > 1, "quality").otherwise("fast").alias("mode"), tries.alias("tries"))


def _ladder_sql(after: str, first: str) -> str:
    """A retry ladder in SQL: a recursive walk over the attempts."""
    return f"""WITH RECURSIVE {_TRIES}, walk AS (SELECT event_id, [a, b, c, d] AS x, 0 AS i, 'running' AS state, {first} AS mode, 0 AS deaths, FALSE AS reduced FROM e
UNION ALL SELECT event_id, x, i + 1, {after} FROM walk WHERE state = 'running' AND i < 4)"""


@query(_ladder_sql("""CASE WHEN x[i + 1] = 'ok' THEN 'done' WHEN (x[i + 1] = 'oom' AND NOT reduced) OR (x[i + 1] = 'died' AND deaths = 0) THEN 'running' ELSE 'failed' END,
CASE WHEN x[i + 1] = 'oom' AND NOT reduced THEN 'fast' ELSE mode END, deaths + CASE WHEN x[i + 1] = 'died' THEN 1 ELSE 0 END, reduced OR x[i + 1] = 'oom'""", "'asked'") + "SELECT event_id, arg_max(state, i) AS state, arg_max(mode, i) AS mode FROM walk GROUP BY event_id")
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of jobs by their attempts."""
    return _attempts(spark, sf_dir).select("event_id", jobs.outcome(F.col("tries")).alias("o")).select("event_id", "o.state", "o.mode")


@query(_ladder_sql("""CASE WHEN x[i + 1] = 'ok' THEN 'done' WHEN (x[i + 1] = 'oom' AND mode = 'quality') OR (x[i + 1] = 'died' AND deaths = 0) THEN 'running' ELSE 'failed' END,
CASE WHEN x[i + 1] = 'oom' THEN 'fast' ELSE mode END, CASE WHEN x[i + 1] = 'oom' THEN 0 WHEN x[i + 1] = 'died' THEN 1 ELSE deaths END, reduced OR (x[i + 1] = 'oom' AND mode = 'quality')""", "CASE WHEN quality THEN 'quality' ELSE 'fast' END")
+ "SELECT event_id, arg_max(state, i) AS state, arg_max(mode, i) AS mode, arg_max(reduced, i) AS reduced FROM walk GROUP BY event_id")
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of single pages by their attempts, in either mode."""
    return _attempts(spark, sf_dir).select("event_id", jobs.page_outcome(F.col("tries"), F.col("mode")).alias("o")).select("event_id", "o.*")


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'pending' WHEN event_id // 2 % 2 = 1 THEN 'cancelled' WHEN event_id // 4 % 2 = 1 THEN 'paused' END AS state FROM events")
def interrupt_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda k: F.floor(F.col("event_id") / k) % 2 == 1
    return table(spark, sf_dir, "events").select("event_id", jobs.interrupt(bit(1), bit(2), bit(4)).alias("state"))


@query(f"WITH {_LOG}, e AS (SELECT job AS id, t, CASE WHEN event_id % 7 = 0 THEN 'result' WHEN event_id % 11 = 0 THEN 'error' ELSE 'progress' END AS event FROM log) SELECT id, coalesce(arg_min(event, t) FILTER (WHERE event <> 'progress'), 'timeout') AS outcome, count(*) FILTER (WHERE event = 'progress') AS progress FROM e GROUP BY id")
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 7 == 0, "result").when(F.col("event_id") % 11 == 0, "error").otherwise("progress")
    return jobs.correlated(_events(spark, sf_dir).select(F.col("job").alias("id"), F.col("t").alias("seq"), kind.alias("event")))


@query("""WITH e AS (SELECT user_id AS job, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events),
s AS (SELECT job, ts, sum(begins) OVER (PARTITION BY job ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT job, count(DISTINCT k) AS sessions, max(n) AS longest FROM (SELECT job, k, count(*) AS n FROM s GROUP BY job, k) GROUP BY job""")  # fmt: skip
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.idle_sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 360)
    return found.groupBy(F.col("user_id").alias("job")).agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'not a JSON object' WHEN event_id % 7 = 0 THEN 'unknown event' WHEN event_id % 5 = 0 THEN 'missing tokens' WHEN event_id % 13 = 0 THEN 'neither cmd nor event' END AS problem,
CASE WHEN event_id % 11 > 0 AND event_id % 7 > 0 AND event_id % 5 > 0 AND event_id % 13 > 0 THEN CAST(user_id AS VARCHAR) END AS id FROM events""")  # fmt: skip
def protocol_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress lines made of events, some of them cut off, of an unknown kind, or without a field."""
    n = F.col("event_id")
    kind = F.when(n % 7 == 0, "nothing").otherwise("progress")
    field = F.when(n % 5 == 0, "other2").otherwise("tokens")
    name = F.when((n % 13 == 0) & ~((n % 7 == 0) | (n % 5 == 0)), "other").otherwise("event")
    line = F.concat(F.lit('{"'), name, F.lit('":"'), kind, F.lit('","id":"'), F.col("user_id").cast("string"), F.lit('","'), field, F.lit('":1}'))
    lines = table(spark, sf_dir, "events").select("event_id", F.when(n % 11 == 0, F.substring(line, 1, 9)).otherwise(line).alias("line"))
    return protocol.decode(lines).select("event_id", "problem", F.col("message")["id"].alias("id"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'hash' WHEN doc_id % 6 = 0 THEN 'size' ELSE 'ok' END AS status FROM documents""")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are missing, altered in place, or cut short."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    manifest = docs.select("path", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.lit(None).cast("string").alias("git_sha1"))
    n = F.col("doc_id")
    altered = F.when(n % 7 == 0, F.concat(F.lit("#"), F.substring("text", 2, 1 << 30))).when(n % 6 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    plain = F.octet_length(F.substring("text", 1, 1))  # the first character is replaced byte for byte
    same = F.when(n % 7 == 0, F.concat(F.repeat(F.lit("#"), plain), F.substring("text", 2, 1 << 30))).otherwise(altered)
    have = docs.where(n % 10 != 0).select("path", same.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return integrity.verify(manifest, have)


@query("SELECT doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS digest FROM documents")
def blob_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", integrity.blob_sha1(F.col("text")).alias("digest"))


@query("""WITH p AS (SELECT doc_id, ['{s}/{n}.txt', 'a..b/{s}/{n}', '/{s}/{n}', 'C:{s}', '{s}\\..\\{n}', '..', '{s}/..', '\\\\host\\{s}', '', '../{s}'][doc_id % 10 + 1] AS f, source, doc_id % 10 < 2 AS safe FROM documents)
SELECT doc_id, replace(replace(f, '{s}', source), '{n}', CAST(doc_id AS VARCHAR)) AS path, safe FROM p""")  # fmt: skip
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of ten forms, of which the first two stay below their folder."""
    forms = ("{s}/{n}.txt", "a..b/{s}/{n}", "/{s}/{n}", "C:{s}", "{s}\\..\\{n}", "..", "{s}/..", "\\\\host\\{s}", "", "../{s}")
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("doc_id") % 10).cast("int") + 1)
    path = F.replace(F.replace(form, F.lit("{s}"), F.col("source")), F.lit("{n}"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).select("doc_id", "path", integrity.is_safe(F.col("path")).alias("safe"))


@query("""WITH RECURSIVE edges AS (SELECT doc_id AS name, doc_id // 2 AS needs FROM documents UNION ALL SELECT 0, 5 UNION ALL SELECT 1, 2), c AS (SELECT doc_id AS name FROM documents WHERE doc_id % 97 = 96 UNION SELECT e.needs FROM c JOIN edges e ON e.name = c.name)
SELECT CAST(name AS VARCHAR) AS name FROM c""")  # fmt: skip
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every 97th document needs, each one half its number; two edges close cycles."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    edge = lambda name, needs: (name.cast("string").alias("name"), needs.cast("string").alias("needs"))
    halves = docs.select(*edge(F.col("doc_id"), F.floor(F.col("doc_id") / 2)))
    back = spark.range(2).select(*edge(F.col("id"), F.when(F.col("id") == 0, 5).otherwise(2)))
    return integrity.closure(halves.unionByName(back), docs.where("doc_id % 97 = 96").select(F.col("doc_id").cast("string").alias("name")))


@query("SELECT DISTINCT source || '-' || lang || '-x' AS name FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND source || '-' || lang || '-x' NOT IN (SELECT source || '-' || lang || '-x' FROM documents WHERE doc_id % 20 = 0 AND source IS NOT NULL AND lang IS NOT NULL)")
def unlisted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of bundled parts, written with other separators and case than in the list."""
    docs = table(spark, sf_dir, "documents")
    sep = F.element_at(F.array(*map(F.lit, ("_", ".", "--", "-._"))), (F.col("doc_id") % 4).cast("int") + 1)
    bundled = docs.select(F.concat(F.upper("source"), sep, "lang", sep, F.lit("X")).alias("name")).where("name IS NOT NULL")
    return integrity.unlisted(bundled, docs.where("doc_id % 20 = 0").select(F.concat_ws(".", "source", "lang", F.lit("x")).alias("name")))


@query("SELECT doc_id, contains(lower(text), 'the') OR doc_id % 3 = 0 AS hit FROM documents")
def name_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that hold a name in UTF-8, or, in every third, in UTF-16."""
    wide = F.concat(F.encode(F.col("text"), "UTF-8"), F.when(F.col("doc_id") % 3 == 0, F.encode(F.lit("xTHEx"), "UTF-16LE")).otherwise(F.encode(F.lit(""), "UTF-8")))
    return table(spark, sf_dir, "documents").select("doc_id", integrity.holds_name(wide, "The").alias("hit"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/in/' || doc_id || '.PNG' WHEN 1 THEN '/in/' || doc_id || '.ocr.pdf' WHEN 2 THEN '/in/' || doc_id || '.md' WHEN 3 THEN '/in/' || (doc_id - 1) || '_images/' || doc_id || '.png' WHEN 4 THEN '/in/' || doc_id || '_images/1.png' ELSE '/in/' || doc_id || '.txt' END AS path FROM documents)
SELECT path FROM f WHERE doc_id % 6 IN (0, 4) OR (doc_id % 6 = 3 AND doc_id % 4 = 1)""")  # fmt: skip
def found_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures, outputs of an earlier run, sheets and picture crops beside them, some of them named themselves."""
    n = F.col("doc_id").cast("string")
    forms = [F.concat(F.lit("/in/"), n, F.lit(x)) for x in (".PNG", ".ocr.pdf", ".md")]
    forms += [F.concat(F.lit("/in/"), (F.col("doc_id") - 1).cast("string"), F.lit("_images/"), n, F.lit(".png")), F.concat(F.lit("/in/"), n, F.lit("_images/1.png")), F.concat(F.lit("/in/"), n, F.lit(".txt"))]
    path = F.element_at(F.array(*forms), (F.col("doc_id") % 6).cast("int") + 1)
    return files.find_inputs(table(spark, sf_dir, "documents").select(path.alias("path"), (F.col("doc_id") % 4 == 1).alias("given")))


@query("SELECT '/s/' || source AS folder, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/s/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").alias("length"))
    return integrity.folder_sizes(docs)


@query("""SELECT lang, CAST(sum(n_chars) AS BIGINT) AS size, lang IN (SELECT lang FROM documents WHERE source = 'src3' AND doc_id % 2 = 0) AS installed, CASE WHEN lang > 'en' THEN arg_max(source, doc_id) END AS state FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def languages_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by language, whether it is installed, and the last state of its job, of which some have none."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    last = jobs.latest(docs.where("lang > 'en'"), "lang", "source", ["doc_id"]).withColumnRenamed("source", "state")
    return jobs.languages_status(docs.select("lang", F.col("n_chars").alias("size")), docs.where("source = 'src3' AND doc_id % 2 = 0").select("lang").distinct(), last)


@query("SELECT event_id, greatest(0, 17179869184 - event_id * 4194304) AS needed FROM events")
def disk_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jobs.free_bytes_needed(F.col("event_id") * (4 << 20)).alias("needed"))


@query(f"WITH {_TOTALS}, q AS (SELECT job, arg_max(state, (t, event_id)) AS state FROM log GROUP BY job) SELECT x.job AS id, x.job || '.pdf' AS name, CASE WHEN state IN ('pending', 'running', 'paused') AND seconds > 0 THEN round(seconds / pages_done * (x.job % 3), 3) END AS eta FROM totals x JOIN q ON q.job = x.job WHERE x.job % 3 > 0 UNION ALL SELECT job, job || '.pdf', NULL FROM totals WHERE job % 3 = 0")
def job_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and time left of jobs of which up to two pages are left."""
    rows = _totals(spark, sf_dir).join(_queue(spark, sf_dir).withColumnRenamed("id", "job"), "job")
    folder = F.when(F.col("job") % 2 == 0, "C:\\d\\").otherwise("/d/")
    seen = rows.select(F.col("job").alias("id"), "state", "seconds", "pages_done", (F.col("pages_done") + F.col("job") % 3).alias("pages_total"), F.concat(folder, F.col("job").cast("string"), F.lit(".pdf")).alias("source"))
    return jobs.job_view(seen).select("id", "name", F.round("eta", 3).alias("eta"))


@query("SELECT doc_id, CAST(1 + doc_id % 2 AS INT) AS n_pages, CAST(2 + doc_id % 2 AS INT) AS n_blocks, 1 AS n_flags, TRUE AS same FROM documents")
def sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to JSON, back, to flat tables, and together again."""
    flag = F.struct(F.lit("suspicious").alias("kind"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("x").alias("original"), F.lit("").alias("note"))

    def block(label: str, flags) -> Column:
        box = F.struct(*(F.lit(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))
        return F.struct(F.lit(label).alias("label"), box.alias("box"), F.col("text"), F.col("text").alias("raw_text"), flags.alias("flags"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,original:string,note:string>>")

    def page(i: int, blocks) -> Column:
        return F.struct(F.lit(i).alias("index"), F.lit("ocr").alias("source"), F.lit(None).cast("string").alias("mode"), F.lit(1).alias("width_px"), F.lit(2).alias("height_px"), F.lit(0).alias("rotation_applied"), blocks.alias("blocks"), F.lit("").alias("raw"), F.array(F.lit("w")).alias("warnings"), F.lit(0.5).alias("seconds"))

    first = page(0, F.array(block("title", none), block("text", F.array(flag))))
    pages = F.when(F.col("doc_id") % 2 == 0, F.array(first)).otherwise(F.array(first, page(1, F.array(block("list", none)))))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.lit("p").alias("source_path"), F.lit("e").alias("engine_id"), F.lit("r").alias("engine_revision"), F.lit("v").alias("app_version"), F.lit("2026-01-01T00:00:00").alias("created"), pages.alias("pages")).alias("d"))
    told = docs.select("doc_id", F.to_json("d", {"ignoreNullFields": "false"}).alias("json"))
    read = told.select("doc_id", F.from_json("json", DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("doc_id", "d.*")
    pages_, blocks_, flags_ = files.explode_document(read)
    again = files.assemble_document(read.drop("pages"), pages_, blocks_, flags_)
    compared = told.join(again.select("doc_id", F.to_json(F.struct(*[c for c in again.columns if c != "doc_id"]), {"ignoreNullFields": "false"}).alias("again")), "doc_id")
    counts = read.select("doc_id", F.size("pages").alias("n_pages"), F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(p["blocks"])).alias("n_blocks"), F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(F.flatten(p["blocks"]["flags"]))).alias("n_flags"))
    return counts.join(compared.select("doc_id", (F.col("json") == F.col("again")).alias("same")), "doc_id")


@query(f"""WITH {_QUEUE} SELECT CAST(id AS VARCHAR) AS id, state, pos, CASE WHEN id % 2 = 0 THEN 'x=/n;y=/' || id ELSE 'x=/' || id || ';y=/' || id END AS outputs FROM queue
UNION ALL SELECT 'new' || id, CASE WHEN id % 5 = 0 THEN 'failed' ELSE 'pending' END, (SELECT max(pos) FROM queue) + row_number() OVER (ORDER BY 'new' || id), NULL FROM queue WHERE id % 11 = 0""")  # fmt: skip
def queue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New jobs at the end of the list, some of them unreadable, and outputs merged into old ones."""
    n = F.col("id").cast("string")
    given = _queue(spark, sf_dir)
    old = given.select(n.alias("id"), "state", "pos", F.create_map(F.lit("x"), F.concat(F.lit("/"), n), F.lit("y"), F.concat(F.lit("/"), n)).alias("outputs"))
    new = given.where("id % 11 = 0").select(F.concat(F.lit("new"), n).alias("id"), F.lit("/s").alias("source"), F.when(F.col("id") % 5 == 0, "unreadable").alias("error"))
    more = given.where("id % 2 = 0").select(n.alias("id"), F.create_map(F.lit("x"), F.lit("/n")).alias("outputs"))
    merged = jobs.merged_outputs(jobs.added_jobs(old, new), more)
    told = F.array_join(F.array_sort(F.transform(F.map_entries("outputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return merged.select("id", "state", "pos", told.alias("outputs"))


@query(f"WITH {_QUEUE} SELECT id FROM queue WHERE state NOT IN ('done', 'failed', 'cancelled')")
def open_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.without_finished(_queue(spark, sf_dir)).select("id")


@query("SELECT source, bool_and(doc_id % 10 > 0 AND doc_id % 7 > 0 AND doc_id % 6 > 0) AND source <> 'src5' AS ready FROM documents GROUP BY source")
def manifest_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all files of each source are sound and of the wanted revision, which one source's aren't."""
    n = F.col("doc_id")
    checked = table(spark, sf_dir, "documents").select("source", F.when((n % 10 > 0) & (n % 7 > 0) & (n % 6 > 0), "ok").otherwise("hash").alias("status"))
    return integrity.are_ready(checked, ["source"], F.col("source") != "src5")


