"""Filter interaction audit: what each filter does at each step of every order in which the filters may be applied.

A document's outcome under any order follows from the set of filters that it fails, a mask of five bits. So the
documents of a part are counted by mask, all of them and those with a label, and these histograms are rows of an
incidence matrix. Its products with integer 32-by-600 matrices (masks by orders and steps) are the counts: documents
kept after a step, removed by it, redundant (they fail its filter and were removed before) and those failing it alone.

Whether a text is a repeat is looked up in a table of the texts that stand under several ids, by digest; labels are joined
by id. Both joins are of narrow rows, and a text or id of very many rows is one that the planner splits.

Defined results: a null text is an empty one, a null part the empty string; a text repeats if the same text stands under a smaller id
anywhere in the table: rows that repeat an id aren't repeats of each other, and a null id is smaller than none and
has no smaller one; a document counts as labelled once, however many rows of labels say so; labels with a null id count
nowhere; a part with documents has all its rows, zeros included; an empty table gives no rows; other columns may be there,
whatever their names; a text of any length is taken whole. Distinct words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import WORD_BYTES, arrow_column, byte_set, checkpoint, chunks, per_doc, span_hashes, word_bounds

#: The filters, in the order of a mask's bits, and what they ask for.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: The characters of the fourth filter and the capitals of the third.
MARKS = byte_set(*map(ord, "#$%&*|"))
CAPITALS = byte_set((0x41, 0x5A))
CONTINUED = byte_set((0x80, 0xBF))
REPEAT = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Parts whose rows a task makes at a time.
PARTS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def masks(texts: pa.Array) -> pa.Array:
    """The filters A to D that each text fails."""
    out = []
    for c in chunks(texts):
        starts, ends, first = word_bounds(c.data, c.offsets, WORD_BYTES)
        words = span_hashes(c.data, starts, ends)
        n = np.diff(first)
        distinct = np.array([len(np.unique(words[a:b])) for a, b in itertools.pairwise(first.tolist())], np.int64)
        capitals, marks, points = (per_doc(member[c.data], c.offsets) for member in (CAPITALS, MARKS, ~CONTINUED))
        fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, marks > 0)
        out.append(sum(f.astype(np.int32) << i for i, f in enumerate(fails)))
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32())


def mask(text: Column) -> Column:
    return arrow_column(lambda: masks, "int")(text)


def outcomes() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The orders' steps, and for each outcome its matrix of masks by steps."""
    steps = [("".join(order), step) for order in itertools.permutations(FILTERS) for step in range(1, len(FILTERS) + 1)]
    all_masks = np.arange(MASKS)[:, None]
    before = np.array([sum(1 << FILTERS.index(f) for f in order[: step - 1]) for order, step in steps])
    own = np.array([1 << FILTERS.index(order[step - 1]) for order, step in steps])
    early, fails = (all_masks & before) != 0, (all_masks & own) != 0
    made = {"kept": ~early & ~fails, "removed": fails & ~early, "redundant": fails & early, "unique_fails": np.broadcast_to(all_masks == own, fails.shape)}
    return steps, {name: m.astype(np.int64) for name, m in made.items()}


def audited(rows: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by part and step from histograms (parts by masks)."""
    steps, by = outcomes()
    out = {name: rows @ m for name, m in by.items()}
    out |= {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
    # each filter's removed of all orders, at whatever step it stands
    same = np.array([FILTERS.index(order[step - 1]) for order, step in steps])
    sums = np.stack([out["removed"][:, same == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    return out | {"shapley": sums[:, same]}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each part, order and step from rows of a part and its histograms."""
    steps, _ = outcomes()
    orders, numbers = pa.array([o for o, _ in steps]), np.array([s for _, s in steps], np.int32)
    for batch in batches:
        for lo in range(0, batch.num_rows, PARTS):
            few = batch.slice(lo, PARTS)
            counts = audited(*(few.column(c).flatten().to_numpy().reshape(-1, MASKS) for c in ("rows", "good", "toxic")))
            part = few.column("part").take(pa.array(np.repeat(np.arange(few.num_rows), len(steps))))
            order = pa.concat_arrays([orders] * few.num_rows)
            yield pa.record_batch([part, order, pa.array(np.tile(numbers, few.num_rows)), *(pa.array(counts[c].ravel()) for c in COUNTS)], names=["part", "filter_order", "step", *COUNTS])


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part and mask of every row."""
    known = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = checkpoint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(known.cast("binary"), 256)).alias("digest"), mask(known).alias("mask")))
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    repeat = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    return rows.join(shared, "digest", "left").select("doc_id", "part", F.when(repeat, F.col("mask").bitwiseOR(REPEAT)).otherwise(F.col("mask")).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of each part, order and step."""
    failed = failures(docs, doc_id, text, part)
    named = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*named).where("good OR toxic")
    counted = failed.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("rows"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    of = lambda c: F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(MASKS))).cast("array<long>").alias(c)
    histograms = counted.groupBy("part").agg(of("rows"), of("good"), of("toxic"))
    return histograms.mapInArrow(_rows, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")
