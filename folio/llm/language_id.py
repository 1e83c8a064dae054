"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams of lengths 1 to 3 that both hold (a blended spectrum of
presences), divided by the root of both own numbers. Nyström landmarks turn it into features, and one ridge
regression for each language, against the rest, is fitted on them. Batches of documents are scored by two matrix
products: presences with the landmarks', and the kernel values with the regressions' coefficients.

N-grams are exact: a gram is its letters' code points, 21 bits each, so that no two share a column. What isn't a letter
parts words and counts as one mark.

The model is fitted on a bounded sample: of the MOST_LANGUAGES commonest languages, the rows of least seeded hash of
id and text among those that aren't held out, equal rows once, PER_LANGUAGE of each and MOST_ROWS in all, whatever ids they
share; texts of over SAMPLE_BYTES only where a language has no other, then its shortest. Landmarks are the first of these by hash, equal ones once.
Prediction covers every whole text.

Defined results: a null text, and one without a letter, is `und` with score 0; so is every text if there is no row to
learn from; ties go to the language that sorts first; repeated rows get equal results; other columns are kept,
and one that is named as the result is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import arrow_column, held_out

#: Sampled rows of a language and of all, languages, rows of one without a short text, and bytes of a short text.
PER_LANGUAGE, MOST_ROWS, MOST_LANGUAGES, LONG_ROWS, SAMPLE_BYTES = 300, 3000, 1000, 2, 32768
#: Landmarks of a language, and cells of the landmarks' matrix and of a batch's (4 bytes each).
LANDMARKS, MOST_CELLS, BATCH_CELLS = 24, 8 << 20, 2 << 20
RIDGE = 1e-3
#: Below this score no language claims a document.
CLAIM = 0.3
#: Letters of a text up to which grams are marked in a table of all that they can make; with more they are sorted.
ALPHABET = 96
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray
    landmarks: np.ndarray
    own: np.ndarray
    weights: np.ndarray


class Grams:
    """Presences of n-grams; holds the tables that a worker uses again and again."""

    def __init__(self) -> None:
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        #: The symbol of each code point: 1 parts words, letters are two above their code point.
        self.symbols = np.where(letters, np.arange(0x110000) + 2, 1).astype(np.int32)
        self.seen, self.place = np.zeros(0x110002, bool), np.zeros(0x110002, np.int32)
        self.flags = np.zeros(ALPHABET + ALPHABET**2 + ALPHABET**3, bool)

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct codes of a text's grams of lengths 1 to 3."""
        s = np.concatenate(([1], self.symbols[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)], [1])).astype(np.int64)
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 1) | (s[:-1] > 1)  # what parts two words counts once
        s = s[keep]
        self.seen[s] = True
        letters = np.flatnonzero(self.seen[: s.max() + 1])
        self.seen[letters] = False
        k = len(letters)
        if k > ALPHABET:
            two = s[:-1] << 21 | s[1:]
            return np.unique(np.concatenate((s, two, two[:-1] << 21 | s[2:])))
        self.place[letters] = np.arange(k)
        c = self.place[s]
        two = c[:-1] * k + c[1:]
        flags = self.flags[: k + k**2 + k**3]
        flags[c] = True
        flags[k + two] = True
        flags[k + k**2 + two[:-1] * k + c[2:]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        cut = np.searchsorted(found, [k, k + k**2])
        two, three = found[cut[0] : cut[1]] - k, found[cut[1] :] - (k + k**2)
        return np.concatenate((letters[found[: cut[0]]], letters[two // k] << 21 | letters[two % k], (letters[three // k**2] << 42) | (letters[three // k % k] << 21) | letters[three % k]))


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """A model of (text, language) rows; landmarks are those that come first."""
    rows = [(text, lang) for text, lang in rows if text and lang is not None and _LETTER.search(text)]
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    of = Grams().of
    grams = [of(text) for text, _ in rows]
    model = Model(languages, *_landmarks(grams, [lang for _, lang in rows], languages), np.zeros((0, 0), np.float32))
    values = np.concatenate(list(_kernels(grams, model))).astype(np.float64)
    # Nystroem features: the kernel with the landmarks times the inverse root of the landmarks' own kernel
    own = model.landmarks.astype(np.float64)
    size, basis = np.linalg.eigh(own @ own.T / np.sqrt(np.outer(model.own, model.own)))
    kept = size > 1e-6 * size[-1]
    root = basis[:, kept] / np.sqrt(size[kept])
    features = np.concatenate([values @ root, np.ones((len(rows), 1))], axis=1)
    sides = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in rows])
    counts = {x: sum(lang == x for _, lang in rows) for x in languages}
    weight = np.array([1 / counts[lang] for _, lang in rows])[:, None]
    gram = features.T @ (features * weight)
    solved = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), features.T @ (sides * weight))
    model.weights = np.concatenate([root @ solved[:-1], solved[-1:]]).astype(np.float32)
    return model


def _landmarks(grams: list[np.ndarray], langs: list[str], languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, presences and sizes of the first LANDMARKS different rows of each language, fewer if they have too many cells."""
    each: dict[str, dict[bytes, np.ndarray]] = {x: {} for x in languages}
    for g, lang in zip(grams, langs, strict=True):
        if len(each[lang]) < LANDMARKS:
            each[lang].setdefault(g.tobytes(), g)
    for most in range(LANDMARKS, 0, -1):
        chosen = [g for x in languages for g in list(each[x].values())[:most]]
        vocabulary = np.unique(np.concatenate(chosen))
        if len(vocabulary) * len(chosen) <= MOST_CELLS:
            break
    table = np.zeros((len(chosen), len(vocabulary)), np.float32)
    for row, g in enumerate(chosen):
        table[row, np.searchsorted(vocabulary, g)] = 1
    return vocabulary, table, np.array([len(g) for g in chosen], np.float32)


def _kernels(grams: list[np.ndarray], model: Model) -> Iterator[np.ndarray]:
    """Kernel values with all landmarks, a matrix product for each batch of rows."""
    batch = max(1, BATCH_CELLS // len(model.vocabulary))
    for lo in range(0, len(grams), batch):
        part = grams[lo : lo + batch]
        present = np.zeros((len(part), len(model.vocabulary)), np.float32)
        for row, codes in enumerate(part):
            at = np.minimum(np.searchsorted(model.vocabulary, codes), len(model.vocabulary) - 1)
            present[row, at[model.vocabulary[at] == codes]] = 1
        sizes = np.array([len(x) for x in part], np.float32)
        yield present @ model.landmarks.T / np.sqrt(sizes[:, None] * model.own)


def predictor(model: Model | None) -> Callable[[pa.Array], pa.Array]:
    """What gives the language and score of each text."""
    of = Grams().of if model is not None else None

    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if model is not None:
            given = [(at, of(text)) for at, text in enumerate(texts.to_pylist()) if text and _LETTER.search(text)]
            at = 0
            for values in _kernels([g for _, g in given], model):
                sides = values @ model.weights[:-1] + model.weights[-1]
                best = sides.argmax(axis=1)
                for k, s in zip(best.tolist(), sides[np.arange(len(best)), best].tolist(), strict=True):
                    names[given[at][0]], scores[given[at][0]] = model.languages[k], min(1.0, max(0.0, (s + 1) / 2))
                    at += 1
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predict


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, seed: int = 5) -> list[tuple[str, str]]:
    """The rows to learn from, in order of their drawn numbers."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i"), 3, 1))
    size = F.octet_length("t")
    short = size <= SAMPLE_BYTES
    counts = rows.groupBy("l").agg(F.count("*").alias("n"), F.count_if(short).alias("short"), F.min(size).alias("least")).orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES).toArrow()
    if not counts.num_rows:
        return []
    quota = max(1, min(PER_LANGUAGE, MOST_ROWS // counts.num_rows))
    few = F.broadcast(docs.sparkSession.createDataFrame(counts))
    drawn = F.xxhash64(F.lit(seed), F.col("i").cast("string"), "t")
    eligible = rows.join(few, "l").where(F.when(F.col("short") > 0, short).otherwise(size == F.col("least")))
    placed = eligible.select("l", "t", drawn.alias("drawn"), F.when(F.col("short") > 0, quota).otherwise(min(quota, LONG_ROWS)).alias("most"))
    # the numbers alone are ranked, equal rows once; texts are read again up to a language's last number
    rank = F.row_number().over(W.partitionBy("l").orderBy("drawn"))
    last = placed.select("l", "drawn", "most").distinct().withColumn("rank", rank).where(F.col("rank") <= quota).where("rank <= most").groupBy("l").agg(F.max("drawn").alias("last"))
    cut = F.broadcast(docs.sparkSession.createDataFrame(last.toArrow()))
    chosen = placed.join(cut, "l").where("drawn <= last").groupBy("l", "drawn").agg(F.min("t").alias("t"))
    return [(r.t, r.l) for r in chosen.orderBy("drawn", "l").collect()]


def _predictor(model: Broadcast) -> Callable[..., Column]:
    return arrow_column(lambda: predictor(model.value), "lang string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", out: str = "language") -> DataFrame:
    """Add a struct `out` with lang and score, learned from the rows of `docs` that aren't held out."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, doc_id, text, lang)))
    return docs.withColumn(out, _predictor(model)(F.col(f"`{text}`")))
