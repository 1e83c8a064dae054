"""Quality scores by votes of the nearest labelled documents in a latent-semantic space.

A document's terms are triples of collapsed character classes (letters by case, digits, white space, kinds of
punctuation), hashed lower-cased words, and signs of repetition: words equal to one of the last eight, lines equal to
an earlier line, words of repeated eight-word windows. Square roots of term shares are projected by a truncated
singular value decomposition of the labelled sample; the sample's vectors are broadcast (SAMPLE rows of RANK numbers
at most), every document's cosines with all of them are computed in blocks, and the labels of the NEIGHBOURS nearest
are averaged with weights that grow with similarity.

The model is fitted on a bounded sample: about SAMPLE / 2 rows of either label, drawn by a seeded hash of the id from
labelled rows that aren't held out, texts of over SAMPLE_BYTES left to scoring. Scoring covers every whole text.

Defined results: a null text is an empty one; without labelled rows every score is 0.5; an id with several labels counts
as its lowest; labels other than 0 and 1 are ignored; repeated rows get equal scores; of neighbours at equal cosines
those count whose rows were drawn first; a text of any length is one vector; an empty table gives no rows; other columns
are kept, and one that is named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import LOWER, WORD_BYTES, arrow_column, chunks, gram_hashes, held_out, span_hashes, unit_hash, word_bounds

SAMPLE, SAMPLE_BYTES, RANK, NEIGHBOURS, SHARPNESS = 3000, 32768, 48, 15, 8.0
#: Documents scored by one matrix product.
BLOCK = 128
#: Decimal places to which cosines count.
PLACES = 6
WORD_TERMS, SHAPES = 1024, 16
LAGS, WINDOW = 8, 8
SIGNS = LAGS + 3
TERMS = SHAPES**3 + WORD_TERMS + SIGNS
#: Weights of the three kinds of terms.
WEIGHTS = (1.0, 0.35, 1.0)


def _shapes() -> np.ndarray:
    out = np.full(256, 15, np.uint8)
    out[0x80:] = 1
    out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A] = 1, 2, 3
    for shape, characters in enumerate((b" \t", b"\n\r\x0b\x0c", b".", b",;:", b"!?", b"|", b"#", b"*", b"$%&", b"<>", b"'\"()[]{}", b"-_/\\@"), 4):
        out[list(characters)] = shape
    out[0] = 0
    return out


SHAPE_OF = _shapes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of weighted root shares of terms, one for each document of a chunk."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    shape = SHAPE_OF[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[offsets[offsets < len(data)]] = True
    places = np.flatnonzero(keep)
    cuts = np.searchsorted(places, offsets)
    short = shape[places].astype(np.int32)
    starts, ends, first = word_bounds(data, offsets, WORD_BYTES)
    low = span_hashes(LOWER[data], starts, ends)
    exact = span_hashes(data, starts, ends)
    grams = gram_hashes(exact, WINDOW)
    line_at = np.flatnonzero(data == 10)
    for d in range(n):
        s = short[cuts[d] : cuts[d + 1]]
        total = max(1, len(s))
        three = (s[:-2] * SHAPES + s[1:-1]) * SHAPES + s[2:]
        out[d, : SHAPES**3] = WEIGHTS[0] * np.sqrt(np.bincount(three, minlength=SHAPES**3) / total)
        a, b = first[d], first[d + 1]
        words = max(1, b - a)
        counted = np.bincount((low[a:b] >> np.uint64(54)).astype(np.int64), minlength=WORD_TERMS)
        out[d, SHAPES**3 : SHAPES**3 + WORD_TERMS] = WEIGHTS[1] * np.sqrt(counted / words)
        signs = out[d, SHAPES**3 + WORD_TERMS :]
        h = exact[a:b]
        for lag in range(1, LAGS + 1):
            signs[lag - 1] = np.count_nonzero(h[lag:] == h[:-lag]) / words
        own = grams[a : max(a, b - WINDOW + 1)]
        signs[LAGS] = 1 - len(np.unique(own)) / max(1, len(own)) if len(own) else 0
        breaks = line_at[np.searchsorted(line_at, offsets[d]) : np.searchsorted(line_at, offsets[d + 1])]
        lines_from = np.concatenate(([offsets[d]], breaks + 1))
        lines_to = np.concatenate((breaks, [offsets[d + 1]]))
        full = lines_to > lines_from
        lines = span_hashes(data, lines_from[full], lines_to[full])
        signs[LAGS + 1] = 1 - len(np.unique(lines)) / max(1, len(lines)) if len(lines) else 0
        signs[LAGS + 2] = min(1.0, 8 / words)
        signs[:] = WEIGHTS[2] * np.sqrt(signs)
    return out


def all_features(texts: pa.Array):
    """Feature rows of a batch, at most BLOCK documents at a time."""
    for c in chunks(texts):
        for lo in range(0, len(c.offsets) - 1, BLOCK):
            cut = c.offsets[lo : lo + BLOCK + 1]
            yield features(c.data[cut[0] : cut[-1]], cut - cut[0])


@dataclass
class Model:
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """A model of (text, label) rows."""
    if not rows:
        return None
    table = np.concatenate(list(all_features(pa.array([t for t, _ in rows], pa.string()))))
    used = np.flatnonzero((table > 0).sum(axis=0) >= 2)
    if not len(used):
        used = np.arange(TERMS)
    part = table[:, used].astype(np.float64)
    values, vectors = np.linalg.eigh(part.T @ part) if len(used) <= len(part) else np.linalg.eigh(part @ part.T)
    if len(used) > len(part):
        vectors = part.T @ vectors / np.sqrt(np.maximum(values, 1e-12))
    basis = np.zeros((TERMS, min(RANK, vectors.shape[1])), np.float32)
    basis[used] = vectors[:, ::-1][:, : basis.shape[1]]
    return Model(basis, _unit(table @ basis).astype(np.float32), np.array([y for _, y in rows], np.float32))


def vote(rows: np.ndarray, model: Model) -> np.ndarray:
    """Scores of feature rows: exact cosines with every labelled vector, then a weighted vote of the nearest."""
    close = np.round((_unit(rows @ model.basis) @ model.vectors.T).astype(np.float64), PLACES)
    k = min(NEIGHBOURS, close.shape[1])
    # of equal cosines those of rows that were drawn first
    order = np.arange(close.shape[1]) * (0.1**PLACES / SAMPLE / 2) - close
    near = np.argpartition(order, k - 1, axis=1)[:, :k]
    weight = np.exp(SHARPNESS * (np.take_along_axis(close, near, axis=1) - 1))
    return (weight * model.labels[near]).sum(axis=1) / weight.sum(axis=1)


def predict(texts: pa.Array, model: Model | None) -> pa.Array:
    if model is None or not len(texts):
        return pa.array(np.full(len(texts), 0.5))
    found = np.concatenate([vote(rows, model) for rows in all_features(texts)])
    return pa.array(np.clip(found.astype(np.float64), 0, 1))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, seed: int = 6) -> list[tuple[str, int]]:
    """The labelled rows to learn from, about as many of either label."""
    known = labels.select(F.col("doc_id").alias("i"), F.col("quality").alias("q")).where(F.col("q").isin(0, 1) & F.col("i").isNotNull() & ~held_out(F.col("i"), 3, 1)).groupBy("i").agg(F.min("q").cast("int").alias("q"))
    counts = {r.q: r.n for r in known.groupBy("q").agg(F.count("*").alias("n")).collect()}
    drawn = unit_hash(seed, F.col("i").cast("string"))
    chosen = F.lit(False)
    for q, n in counts.items():
        chosen = chosen | ((F.col("q") == q) & (drawn * n < SAMPLE / 2))
    # LIMIT keeps the broadcast side within SAMPLE rows, whatever the labels are
    few = known.where(chosen).orderBy(drawn, "i").limit(SAMPLE)
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES).join(F.broadcast(few), "i")
    return [(r.t, r.q) for r in rows.orderBy(drawn, "i", "t").limit(SAMPLE).select("t", "q").collect()]


def _predictor(model: Broadcast) -> Callable[..., Column]:
    return arrow_column(lambda: lambda texts: predict(texts, model.value), "double")


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """Add the column `out`: how likely a text is of label 1, learned from labelled rows that aren't held out."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, doc_id, text)))
    return docs.withColumn(out, _predictor(model)(F.col(f"`{text}`")))
