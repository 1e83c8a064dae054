"""Input discovery over file listings, page selections, and sidecar documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.schema import BLOCK, DOCUMENT, FLAG, PAGE_KEYS

#: Suffixes of inputs.
SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "pdf")


#: Bytes below which a table isn't worth spreading, and bytes a core above which its splits are enough anyway.
SMALL_BYTES, AMPLE_BYTES = 2 << 20, 128 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; a small one of fewer files than cores is spread, as its row groups may be fewer than its splits."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few = SMALL_BYTES < size < cores * AMPLE_BYTES and len(table.inputFiles()) < cores
    return table.repartition(cores) if few else table


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and time of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def find_inputs(files: DataFrame) -> DataFrame:
    """Inputs among files (path, given: named itself rather than found through a folder), by path without case.

    Outputs of an earlier run don't count, and neither do picture crops `<stem>_images/*` beside a `<stem>.md` that
    were found through a folder.
    """
    low = F.lower("path")
    wanted = F.rlike(low, F.lit(rf"\.(?:{'|'.join(SUFFIXES)})$")) & ~F.endswith(low, F.lit(".ocr.pdf"))
    sheets = files.where(F.endswith(low, F.lit(".md"))).select(F.regexp_replace("path", r"\.[^.]*$", "_images").alias("__crops")).distinct()
    found = files.where(wanted).withColumn("__folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    crops = found.where("NOT given").join(sheets, F.col("__folder") == F.col("__crops"), "left_semi").select("path")
    kept = found.where("given").select("path").unionByName(found.where("NOT given").select("path").join(crops, "path", "left_anti"))
    return kept.distinct().orderBy(F.lower("path"), "path")


def page_selection(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Pages (from 0) that a selection like `1-5,9` names of a document of n_pages pages; none if it isn't valid."""
    valid = F.rlike("pages", F.lit(r"^\s*\d+\s*(?:-\s*\d+\s*)?(?:,\s*\d+\s*(?:-\s*\d+\s*)?)*$"))
    ranges = F.transform(F.split("pages", ","), lambda r: F.transform(F.split(r, "-"), lambda x: F.trim(x).cast("int")))
    named = requests.where(valid).select(*keys, "n_pages", F.explode(ranges).alias("r"))
    low = F.greatest(F.lit(1), F.least(F.col("r")[0], F.element_at("r", -1)))
    high = F.least(F.col("n_pages"), F.greatest(F.col("r")[0], F.element_at("r", -1)))
    inside = named.withColumn("low", low).withColumn("high", high).where("low <= high")
    return inside.select(*keys, F.explode(F.sequence(F.col("low") - 1, F.col("high") - 1)).alias("page_index")).distinct()


def read_sidecars(spark: SparkSession, folder: str, suffix: str = ".json") -> DataFrame:
    """Documents from sidecar files, read strictly."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", f"*{suffix}").json(folder)


def write_sidecars(documents: DataFrame, folder: str) -> None:
    """Documents as JSON, one object a line, nulls kept."""
    documents.select(F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(folder)


def from_json_text(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def explode_document(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, blocks and flags as flat tables; documents need a doc_id."""
    pages = documents.select("doc_id", F.posexplode("pages").alias("page_index", "p"))
    flat = pages.select(*PAGE_KEYS, *(F.col(f"p.{c}") for c in ("source", "mode", "width_px", "height_px", "rotation_applied", "raw", "warnings", "seconds")))
    rows = pages.select(*PAGE_KEYS, F.posexplode("p.blocks").alias("block_no", "b"))
    blocks = rows.select(*PAGE_KEYS, "block_no", "b.label", "b.box", "b.text", "b.raw_text")
    flags = rows.select(*PAGE_KEYS, "block_no", F.posexplode("b.flags").alias("flag_no", "f")).select(*PAGE_KEYS, "block_no", "flag_no", "f.*")
    return flat, blocks, flags


def assemble_document(documents: DataFrame, pages: DataFrame, blocks: DataFrame, flags: DataFrame) -> DataFrame:
    """The inverse of `explode_document`; `documents` has the columns besides pages."""
    keys = [*PAGE_KEYS, "block_no"]
    by_block = flags.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("flag_no", F.struct("kind", "start", "end", "original", "note").alias("f")))).alias("x")).select(*keys, F.col("x.f").alias("flags"))
    none = F.array().cast(f"array<{FLAG}>")
    block = F.struct("label", "box", "text", "raw_text", F.coalesce("flags", none).alias("flags"))
    by_page = blocks.join(by_block, keys, "left").groupBy(*PAGE_KEYS).agg(F.array_sort(F.collect_list(F.struct("block_no", block.alias("b"))), _by("block_no")).alias("x")).select(*PAGE_KEYS, F.col("x.b").alias("blocks"))
    page = F.struct(F.col("page_index").alias("index"), "source", "mode", "width_px", "height_px", "rotation_applied", F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")).alias("blocks"), "raw", "warnings", "seconds")
    by_doc = pages.join(by_page, PAGE_KEYS, "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", page.alias("p"))), _by("page_index")).alias("x")).select("doc_id", F.col("x.p").alias("pages"))
    return documents.join(by_doc, "doc_id", "left")


def _by(field: str):
    return lambda a, b: a[field] - b[field]


def page_count(kind: Column, frames: Column) -> Column:
    """Pages of a file: what its decoder counted, or one."""
    return F.when(kind.isin("pdf", "tif", "tiff"), F.coalesce(frames, F.lit(1))).otherwise(1)
