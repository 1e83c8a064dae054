"""Manifests against files, safe paths, closures and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.lineage import checkpoint


def blob_sha1(content: Column) -> Column:
    """The digest that git gives a file's content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content.cast("binary")))


def verify(manifest: DataFrame, files: DataFrame, deep: bool = True) -> DataFrame:
    """The status of every file of a manifest (path, size, sha256, git_sha1) against files (path, length, content)."""
    have = files.select(F.col("path").alias("__path"), F.col("length").alias("__length"), *([F.col("content").alias("__content")] if deep else []))
    joined = manifest.join(have, F.col("path") == F.col("__path"), "left")
    status = F.when(F.col("__path").isNull(), "missing").when(F.col("size") != F.col("__length"), "size")
    if deep:
        wrong = F.coalesce(F.sha2(F.col("__content").cast("binary"), 256) != F.col("sha256"), F.lit(False)) | F.coalesce(blob_sha1(F.col("__content")) != F.col("git_sha1"), F.lit(False))
        status = status.when(wrong, "hash")
    return joined.select("path", status.otherwise("ok").alias("status"))


def is_ready(checked: DataFrame, wanted_revision: str, revision: str) -> DataFrame:
    """Whether all files are sound and the revision is the wanted one."""
    return checked.agg((F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)) & F.lit(wanted_revision == revision)).alias("ready"))


def are_ready(checked: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """The same for each of several installations; `wanted` tells of a row whether its revision is the wanted one."""
    return checked.groupBy(*keys).agg(F.bool_and((F.col("status") == "ok") & wanted).alias("ready"))


def is_safe(path: Column) -> Column:
    """Whether a path stays below its folder: not absolute, no drive or share, no step up."""
    return (path != "") & ~F.rlike(path, F.lit(r"^[/\\]|^[A-Za-z]:|(?:^|[/\\])\.\.(?:[/\\]|$)|\x00"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All names that can be reached from the roots over edges (name, needs).

    Each round follows the edges of the names that the last one added; it ends when none is new, on cycles too. Rounds
    are as many as the longest of the shortest ways.
    """
    edges = checkpoint(edges.select("name", F.col("needs").alias("__needs")).distinct())
    reached = new = checkpoint(roots.select("name").distinct())
    while not new.isEmpty():
        new = checkpoint(new.join(edges, "name").select(F.col("__needs").alias("name")).where("name IS NOT NULL").distinct().join(reached, "name", "left_anti"))
        reached = checkpoint(reached.unionByName(new))
    return reached


def unlisted(bundled: DataFrame, listed: DataFrame) -> DataFrame:
    """Bundled names (name) that aren't listed, in their normal form, each once."""

    def normal(c: str) -> Column:
        return F.lower(F.regexp_replace(c, "[-_.]+", "-"))

    return bundled.select(normal("name").alias("name")).join(listed.select(normal("name").alias("name")), "name", "left_anti").distinct()


def holds_name(content: Column, name: str) -> Column:
    """Whether content holds a name in UTF-8 or UTF-16, case of ASCII letters aside."""
    low = F.lower(F.decode(content, "ISO-8859-1"))

    def as_text(coding: str) -> Column:
        return F.lit(name.lower().encode(coding).decode("latin-1"))

    return F.contains(low, as_text("utf-8")) | F.contains(low, as_text("utf-16-le"))


def folder_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.sum("length").alias("bytes"))
