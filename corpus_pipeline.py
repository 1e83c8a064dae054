"""A training corpus from raw documents: five stages, each over all that the one before kept.

Language ID drops documents without a letter and those that no language's regression claims; the quality classifier
drops those that are likelier of label 0; groups of near copies (met by SimHash and, beyond its two bits, by
MinHash; linked by a five-word Jaccard of at least 0.8) keep the document of least id; documents that hold a benchmark window go; the last stage encodes what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.lineage import delete_folder
from folio.llm import bpe, decontamination, language_id, near_copies, quality_knn
from folio.llm.common import shared_folder, table
from folio.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.identify(docs, out="__language")
    keep = (F.col("__language.lang") != language_id.UNKNOWN) & (F.col("__language.score") >= language_id.CLAIM)
    return found.where(keep).select(*_columns(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality_knn.score(docs, table(spark, sf_dir, "labels"), out="__quality")
    return scored.where(F.col("__quality") >= 0.5).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash links of operator 4 with the exact check that may follow; near copies that it can't reach are met by MinHash."""
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), out="__decon")
    return found.where(F.size("__decon.spans") == 0).select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number of ids, the packed ids' digest and the decoded text's digest, and the packed ids."""
    done = bpe.encode_decode(docs, tokenizer_path(), out="__bpe")
    return done.select("doc_id", "__bpe.n_tokens", F.sha2("__bpe.packed", 256).alias("ids_sha256"), F.sha2("__bpe.decoded", 256).alias("decoded_sha256"), F.col("__bpe.packed").alias("ids"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: No SQL has these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written to the shared folder and read again for the next.

    What a stage wrote is deleted once the next one has written all of its own; the last one's stays for the result.
    """
    folder, before = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            delete_folder(spark, before)
        before = at
    return docs


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]
