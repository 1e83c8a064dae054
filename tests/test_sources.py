"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from folio.operators import jobs
from folio.schema import DOCUMENT
from folio.sources import export, files, hunspell, protocol
from folio.streaming import jobs as streams


def test_hunspell(spark, tmp_path):
    (tmp_path / "xx.aff").write_text("SET UTF-8\nPFX U Y 1\nPFX U 0 un .\nSFX S Y 2\nSFX S 0 s [^sy]\nSFX S y ies y\n")
    (tmp_path / "xx.dic").write_text("4\ndo/US\nfly/S\nměsto\n\nplain/Z\n")
    spark.dataSource.register(hunspell.HunspellSource)
    read = spark.read.format("hunspell").option("path", str(tmp_path)).option("names", "en=xx,cs=missing").load()
    assert sorted(r.form for r in read.collect()) == sorted(["do", "dos", "undo", "undos", "fly", "flies", "město", "plain"])
    assert {r.lang for r in read.collect()} == {"en"}


@pytest.mark.parametrize(
    ("line", "problem"),
    [
        ('{"event":"progress","id":"1","tokens":5}', None), ('{"cmd":"ping","id":"1"}', None), ('{"event":"progress","id":"1"}', "missing tokens"), ('{"event":"nope"}', "unknown event"),
        ('{"cmd":"ocr","id":"1","image":"a","mode":"fast"}', "missing max_new_tokens, time_limit_s"), ("[1]", "not a JSON object"), ("{oops", "not a JSON object"), ("{}", "neither cmd nor event"), ('{"other":1}', "neither cmd nor event"), ("", "not a JSON object"),
    ],
)
def test_protocol(spark, line, problem):
    row = protocol.decode(spark.createDataFrame([(line,)], "line string")).first()
    assert row.problem == problem and (row.message is None) == (problem is not None)


def test_encoded_lines_are_read_again(spark):
    sent = spark.range(3).select(protocol.encode(F.lit("pong").alias("event"), F.col("id").cast("string").alias("id")).alias("line"))
    good, bad = protocol.split_bad(protocol.decode(sent))
    assert good.count() == 3 and bad.count() == 0


def document(spark):
    flag = {"kind": "suspicious", "start": 0, "end": 1, "original": "x", "note": ""}
    block = {"label": "text", "box": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, "text": "xy", "raw_text": "xy", "flags": [flag]}
    page = {"index": 0, "source": "ocr", "mode": None, "width_px": 1, "height_px": 2, "rotation_applied": 0, "blocks": [block, block | {"label": "image", "box": None, "text": "", "flags": []}], "raw": "", "warnings": ["w"], "seconds": 0.5}
    blank = page | {"index": 1, "source": "blank", "blocks": []}
    whole = {"source_path": "p", "engine_id": "e", "engine_revision": "r", "app_version": "v", "created": "2026-01-01T00:00:00", "pages": [page, blank]}
    return spark.createDataFrame([(json.dumps(whole),)], "value string"), whole


def test_sidecars(spark, tmp_path):
    lines, whole = document(spark)
    docs = files.from_json_text(lines)
    files.write_sidecars(docs, str(tmp_path / "out"))
    back = spark.read.schema(DOCUMENT).json(str(tmp_path / "out"))
    assert [r.asDict(True) for r in back.collect()] == [whole]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(whole, indent=1))
    assert files.read_sidecars(spark, str(tmp_path / "in")).first().asDict(True) == whole
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        files.from_json_text(spark.createDataFrame([("{bad",)], "value string")).collect()


def test_flat_and_nested_forms(spark):
    lines, whole = document(spark)
    docs = files.from_json_text(lines).withColumn("doc_id", F.lit(7))
    pages, blocks, flags = files.explode_document(docs)
    assert (pages.count(), blocks.count(), flags.count()) == (2, 2, 1)
    again = files.assemble_document(docs.drop("pages"), pages, blocks, flags).drop("doc_id")
    assert again.first().asDict(True) == whole


def test_export(spark, tmp_path):
    docs = files.from_json_text(document(spark)[0]).withColumn("doc_id", F.lit(7))
    _, blocks, _ = files.explode_document(docs)
    with pytest.raises(ValueError, match="docx"):
        export.export_all(docs, blocks, ["txt", "docx"], str(tmp_path / "a"))
    assert not (tmp_path / "a").exists()
    out = export.export_all(docs, blocks, ["txt", "md", "json"], str(tmp_path / "b"))
    assert spark.read.json(out["txt"]).first().value == "xy\n" and spark.read.json(out["md"]).first().value == "xy\n"
    with pytest.raises(Exception, match="(?i)exists"):
        export.export_all(docs, blocks, ["txt"], str(tmp_path / "b"))


def files_in(folder):
    return {p.name: p.read_text() for p in folder.rglob("*") if p.is_file()} if folder.exists() else {}


def test_files_one_by_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"page{i % 3}.txt", f"text {i}\r\nž") for i in range(20)] + [(99, "empty.txt", None)], "doc_id int, name string, text string").repartition(4)
    export.export_files(docs, str(tmp_path / "out"))
    got = files_in(tmp_path / "out")
    assert len(got) == 21 and got["empty.txt"] == "" and got["page0.txt"] == "text 0\nž" and got["page1_2.txt"] == "text 7\nž"
    assert {p.read_bytes() for p in (tmp_path / "out").rglob("page2*.txt")} == {f"text {i}\r\nž".encode() for i in range(20) if i % 3 == 2}
    # what is there stays as it is
    with pytest.raises(Exception, match="(?i)exists"):
        export.export_files(docs, str(tmp_path / "out"))
    assert files_in(tmp_path / "out") == got and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, "bad/name" if i == 13 else f"{i}.txt", "x") for i in range(20)], "doc_id int, name string, text string").repartition(4)
    with pytest.raises(Exception, match="not a file's name"):
        export.export_files(docs, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


def test_exported_documents_as_files(spark, tmp_path):
    docs = files.from_json_text(document(spark)[0]).withColumn("doc_id", F.lit(7)).withColumn("source_path", F.lit("C:\\scans\\my book.pdf"))
    _, blocks, _ = files.explode_document(docs)
    out = export.export_all(docs, blocks, ["txt", "md", "json"], str(tmp_path / "b"), files=True)
    assert files_in(tmp_path / "b" / "txt") == {"my book.txt": "xy\n"} and set(files_in(tmp_path / "b" / "json")) == {"my book.json"} and len(out) == 3


def test_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.png").write_bytes(b"12")
    (tmp_path / "b.txt").write_bytes(b"1")
    found = files.listing(spark, str(tmp_path))
    assert sorted(r.length for r in found.collect()) == [1, 2]
    assert [r.path.rsplit("/", 1)[-1] for r in files.find_inputs(found.withColumn("given", F.lit(False))).collect()] == ["a.png"]


def test_streamed_pages_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 1, "b")], "doc_id int, page_index int, text string")
    rows.write.json(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
        streams.write_pages_once(stream, str(tmp_path / "out"), str(tmp_path / "mark"), ["doc_id", "page_index"]).start().awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
        rows.unionByName(spark.createDataFrame([(1, 2, "c")], rows.schema)).where("page_index < 2").write.mode("append").json(str(tmp_path / "in"))


def test_streamed_states(spark, tmp_path):
    rows = spark.createDataFrame([("j", 1, "running"), ("j", 3, "done"), ("j", 2, "paused"), ("k", 1, "pending")], "job string, seq int, state string")
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    query = streams.latest_states(stream, "job", "state", ["seq"]).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {r.job: r.state for r in jobs.latest(rows, "job", "state", ["seq"]).collect()}
    assert {r.job: r.state for r in spark.table("states").collect()} == batch == {"j": "done", "k": "pending"}


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_pages_come_once_by_state(spark, tmp_path):
    """Over batches and restarts each key's first page comes out once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    batches = [[(1, 0, "b"), (1, 0, "a"), (1, 1, "c")], [(1, 0, "z"), (2, 0, "d")], [(2, 0, "d"), (1, 1, "c"), (3, 0, None)]]
    for batch in batches:
        spark.createDataFrame(batch, "doc_id int, page_index int, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id int, page_index int, text string").json(str(tmp_path / "in"))
        query = streams.first_pages(stream, ["doc_id", "page_index"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()  # each start goes on where the one before ended
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == [(1, 0, "a"), (1, 1, "c"), (2, 0, "d"), (3, 0, None)]


def test_streamed_idle_stops_equal_the_batch(spark, tmp_path):
    """Late events within the watermark join spans; a span that event time hasn't passed stays open."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = lambda m: f"2026-01-01 00:{m:02}:00"
    batches = [[("a", at(0)), ("a", at(3)), ("b", at(1))], [("a", at(12)), ("a", at(7))], [("b", at(20)), ("a", at(30))], [("c", at(59))]]
    seen = []
    for batch in batches:
        rows = spark.createDataFrame(batch, "job string, t string").selectExpr("job", "CAST(t AS timestamp) AS t")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen += batch
        stream = spark.readStream.schema("job string, t timestamp").parquet(str(tmp_path / "in"))
        streams.idle_stops(stream, "job", "t", 5, late_minutes=10).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, str(r.began), str(r.stops), r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    events = spark.createDataFrame(seen, "job string, t string").selectExpr("job", "CAST(t AS timestamp) AS t")
    batch = {(r.job, str(r.began), str(r.stops), r.events) for r in jobs.idle_sessions(events.withColumn("job", F.col("job")), "job", "t", 5).collect()}
    assert got == {x for x in batch if x[0] != "c"} and len(got) == 4


def test_streamed_rates_equal_the_fold(spark, tmp_path):
    rows = spark.createDataFrame([("j", float(i), "s" if i < 7 else "t", float(i * i % 11)) for i in range(12)], "job string, t double, s string, d double")
    rows.write.json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    query = streams.smoothed_rates(stream, "job").writeStream.format("memory").queryName("rates").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    want = jobs.smoothed_rate(rows, "job", "s", "t", "d").first().rate
    assert abs(spark.table("rates").first().rate - want) < 1e-9


def test_recorded_engine(spark):
    pages = spark.createDataFrame([("p1", "fast"), ("p2", "fast")], "page string, mode string")
    recorded = spark.createDataFrame([("p1", "fast", "raw")], "page string, mode string, text string")
    assert {r.page: r.text for r in streams.recorded_engine(recorded, pages).collect()} == {"p1": "raw", "p2": None}
