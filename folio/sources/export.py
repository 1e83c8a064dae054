"""Writers: documents in several formats, names checked before anything is written."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from folio.operators.render import document_texts, markdown, page_texts, unique_names

FORMATS = ("txt", "md", "json")


def export_all(documents: DataFrame, blocks: DataFrame, formats: list[str], folder: str, flags: DataFrame | None = None, files: bool = False) -> dict[str, str]:
    """Write each format below its own folder as lines of doc_id and value; unknown formats are refused before any is written.

    With `files`, each document is a file of its own, named after its source. Nothing is overwritten: a folder that exists is
    an error, and a failed write leaves no committed files.
    """
    unknown = [f for f in formats if f not in FORMATS]
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    out = {}
    for kind in formats:
        out[kind] = f"{folder}/{kind}"
        if kind == "txt":
            rows = document_texts(page_texts(blocks)).select("doc_id", F.col("text").alias("value"))
        elif kind == "md":
            rows = markdown(blocks, flags=flags).select("doc_id", F.col("markdown").alias("value"))
        else:
            rows = documents.select("doc_id", F.to_json(F.struct(*[c for c in documents.columns if c != "doc_id"]), {"ignoreNullFields": "false"}).alias("value"))
        if files:
            stem = F.regexp_extract("source_path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
            names = documents.select("doc_id", F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), F.lit(f".{kind}")).alias("name"))
            export_files(rows.join(names, "doc_id"), out[kind], text="value")
        else:
            rows.write.mode("errorifexists").json(out[kind])
    return out


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: a folder in the write's temporary one, and how many files it has."""

    folder: str
    files: int


class DocumentFiles(DataSource):
    """A sink that writes one file a row (name string, text string), UTF-8, in a folder a task.

    Options: path, a new or empty folder that all executors and the driver see. Files appear when the whole write is
    committed, by a rename of each task's folder; a write that fails leaves nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentFilesWriter(self.options, schema.fieldNames())


class DocumentFilesWriter(DataSourceWriter):
    def __init__(self, options, columns: list[str]):
        self.path, self.columns = options["path"], columns
        if os.path.isdir(self.path) and os.listdir(self.path):
            raise FileExistsError(f"{self.path} exists and isn't empty")
        if not {"name", "text"} <= set(columns):
            raise ValueError("rows need a name and a text")
        self.temporary = f"{self.path.rstrip('/')}.{uuid.uuid4().hex}.tmp"

    def write(self, rows: Iterator) -> Written:
        """Write a task's rows; an attempt that is made again has a folder of its own."""
        folder, files = uuid.uuid4().hex, 0
        os.makedirs(f"{self.temporary}/{folder}")
        for row in rows:
            if not row.name or os.path.basename(row.name) != row.name or row.name in (".", ".."):
                raise ValueError(f"not a file's name: {row.name!r}")
            with open(f"{self.temporary}/{folder}/{row.name}", "x", encoding="utf-8", newline="") as file:
                file.write(row.text or "")
            files += 1
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        for number, done in enumerate(m for m in messages if m is not None and m.files):
            os.rename(f"{self.temporary}/{done.folder}", f"{self.path}/part-{number:05}")
        shutil.rmtree(self.temporary, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.temporary, ignore_errors=True)


def export_files(texts: DataFrame, folder: str, name: str = "name", text: str = "text", order: str = "doc_id") -> None:
    """Write each row's text to a file of its name; names that are taken get a number before their suffix."""
    texts.sparkSession.dataSource.register(DocumentFiles)
    named = unique_names(texts, name, [order]).select(F.col("unique_name").alias("name"), F.col(text).alias("text"))
    named.write.format("document_files").mode("append").option("path", folder).save()
