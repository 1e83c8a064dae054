"""Scores of readings against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.lineage import checkpoint
from folio.functions.python import accents_of, differences_of, distance_of, fold_of, nfc_of, strings_in
from folio.functions.text import collapse

CER_GATE, ACCENT_GATE = 0.03, 0.95


def normalise(text: Column, is_nfc: bool = False) -> Column:
    """NFC with single spaces; input known to be NFC needs no Python."""
    return collapse(text if is_nfc else nfc_of(text))


def distance(truth: Column, reading: Column) -> Column:
    """Edits between two texts. Its cost is the length where letters are changed in place, else the length times the distance."""
    return distance_of(truth, reading)


def cer(truth: Column, reading: Column) -> Column:
    """Character error rate."""
    return distance(truth, reading) / F.greatest(F.length(truth), F.lit(1))


def cer_without_marks(truth: Column, reading: Column) -> Column:
    return cer(fold_of(truth), fold_of(reading))


def scores(pairs: DataFrame) -> DataFrame:
    """Adds cer, chars and accents to rows with truth and reading."""
    return pairs.withColumn("cer", cer(F.col("truth"), F.col("reading"))).withColumn("chars", F.length("truth")).withColumn("accents", accents_of(F.col("truth"), F.col("reading")))


def confusions(scored: DataFrame, most: int = 12) -> DataFrame:
    """The commonest confusions of accented letters, by count, then name."""
    return scored.select(F.explode("accents.wrong").alias("confusion")).groupBy("confusion").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "confusion").limit(most)


def by_group(scored: DataFrame, *keys: str) -> DataFrame:
    """Error rate by group, weighted by length."""
    return scored.groupBy(*keys).agg((F.sum(F.col("cer") * F.col("chars")) / F.sum("chars")).alias("cer"), F.count("*").alias("pages"))


def gate(scored: DataFrame, *keys: str) -> DataFrame:
    """Whether every page of a group is under the error gate, and pooled accents over theirs."""
    right = F.sum("accents.right") / F.nullif(F.sum("accents.total"), F.lit(0))
    return scored.groupBy(*keys).agg(F.bool_and(F.col("cer") <= CER_GATE).alias("cer_ok"), F.coalesce(right >= ACCENT_GATE, F.lit(True)).alias("accents_ok"))


def note(hit_cap: Column, truth: Column, reading: Column) -> Column:
    blank, said = collapse(truth) == "", F.length(collapse(reading))
    return F.concat_ws(", ", F.when(hit_cap, "hit cap"), F.when(blank & (said > 0), F.concat(F.lit("INVENTED "), said.cast("string"))), F.when(~blank & (said == 0), "EMPTY"))


def disagreements(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Where two arrays of words differ: one row a difference, with its number, kind and context."""
    found = pairs.select(*keys, differences_of(F.col(a), F.col(b)).alias("d"))
    return found.select(*keys, F.col("d.agreed").alias("agreed"), F.posexplode_outer("d.found").alias("i", "x")).select(*keys, "agreed", (F.col("i") + 1).alias("id"), "x.*")


def agreement(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Counts of differences and the share of the first list's words that agree."""
    d = differences_of(F.col(a), F.col(b))
    found = pairs.select(*keys, F.size(a).alias("n"), d.alias("d"))
    return found.select(*keys, F.size(F.filter("d.found", lambda x: x["kind"] == "word")).alias("word_diffs"), F.size(F.filter("d.found", lambda x: x["kind"] == "block")).alias("block_diffs"), (100.0 * F.col("d.agreed") / F.greatest("n", F.lit(1))).alias("agreement"))


#: How files of truths and of readings end; a reading's mode stands before its ending.
TRUTH, READING = ".gt.txt", ".raw.txt"


def pair_files(files: DataFrame) -> DataFrame:
    """page, mode, truth and reading from files (path, text): `<page>.<mode>.raw.txt` beside `<page>.gt.txt` in one folder.

    A page's name may hold dots. A reading without a truth, and a truth without a reading, is left out.
    """
    path = F.col("path")
    truths = files.where(F.endswith(path, F.lit(TRUTH))).select(F.substring(path, F.lit(1), F.length(path) - len(TRUTH)).alias("page"), F.col("text").alias("truth"))
    stem = F.substring(path, F.lit(1), F.length(path) - len(READING))
    mode = F.substring_index(stem, ".", -1)
    read = files.where(F.endswith(path, F.lit(READING))).select(F.substring(stem, F.lit(1), F.length(stem) - F.length(mode) - 1).alias("page"), mode.alias("mode"), F.col("text").alias("reading"))
    return pair_up(truths, read.where("page <> '' AND mode <> ''"))


def pair_up(truths: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings (page, mode, reading) with their page's truth."""
    return readings.join(truths, "page")


#: Bytes of items' texts that one automaton holds about; a node of it takes some tens of bytes in each task.
BLOCK_BYTES = 1 << 20


def passages(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and item_id where an item's whole text stands anywhere in a document's.

    Items are dealt by a hash to blocks of checked size. Each block in turn is sent to all tasks as an automaton of its
    strings (Aho-Corasick), which finds all of them in one walk over a text; no text leaves its row, and what a text
    gives are the items that it holds. Null and empty texts hold and match nothing; ids that repeat count once.
    """
    wanted = checkpoint(items.where("text <> ''").select("item_id", "text", F.xxhash64("text").alias("number")))
    size = wanted.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = -(-size // block_bytes)
    found = None
    for block in range(blocks):
        own = wanted.where(F.pmod("number", F.lit(blocks)) == block)
        strings = docs.sparkSession.sparkContext.broadcast([(r.text, r.number) for r in own.select("text", "number").distinct().collect()])
        met = docs.where("text <> ''").select("doc_id", F.explode(strings_in(F.col("text"), strings)).alias("number"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return docs.select("doc_id").limit(0).crossJoin(items.select("item_id").limit(0))
    return found.join(wanted.select("number", "item_id"), "number").select("doc_id", "item_id").distinct()
