"""Shared helpers: checkpoints, Arrow chunking, vectorised word boundaries and hashes."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.lineage import checkpoint, shared_folder  # noqa: F401  given on to the operators
from folio.sources.files import read_table

#: Documents are handled in chunks of about so many bytes; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Text that a function gets, and so results that it holds, at a time; a longer text comes alone.
PIECE_BYTES = 1 << 20
#: Words above this many bytes are hashed by xxHash instead of the prefix polynomial.
LONG_WORD = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which long rounds of small tables may not bring about by themselves.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added as far as columns of `df` have them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def unit_hash(seed: int, *columns: Column) -> Column:
    """A seeded hash of the columns as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(1 << 53)


@dataclass
class Chunk:
    """Documents lo..hi of a batch: their bytes end to end and hi-lo+1 offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string array into chunks; null texts are empty."""
    flat = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    body = flat.buffers()[2] if len(flat) else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    for lo, hi in runs(offsets, most):
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most so many bytes, or of one text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Slices of a string array of at most so many bytes, or of one text; an empty array is one slice."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), np.int64)
    if not len(sizes):
        yield texts
    for lo, hi in runs(np.concatenate(([0], np.cumsum(sizes))), most):
        yield texts.slice(lo, hi - lo)


def byte_set(*parts: int | tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is True for the bytes and ranges given."""
    out = np.zeros(256, bool)
    for p in parts:
        lo, hi = p if isinstance(p, tuple) else (p, p)
        out[lo : hi + 1] = True
    return out


#: The two word classes of the contracts and the ASCII lower-casing table.
SPACE_BYTES = byte_set((9, 13), 32)
WORD_BYTES = ~SPACE_BYTES
ALNUM_BYTES = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each document the index of its first word (one more at the end)."""
    inside = member[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    after = np.empty(len(data) + 1, bool)
    after[-1] = False
    after[:-1] = inside
    edges = offsets[(offsets < len(data))]
    before[edges] = False
    tails = offsets[offsets > 0]
    after[tails] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        n = max(n, CHUNK_BYTES + 1)
        up = np.full(n, _BASE, np.uint64)
        up[0] = 1
        down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        _POWERS["p"], _POWERS["q"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["p"], _POWERS["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in order; equal bytes have equal hashes wherever they stand.

    Spans are taken in pieces of at most LONG_WORD bytes of text, so that memory doesn't follow the text's length.
    """
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(LONG_WORD + 1)
    i = 0
    while i < len(starts):
        if ends[i] - starts[i] > LONG_WORD:
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + LONG_WORD, "right")))
        base = starts[i]
        sums = np.zeros(int(ends[j - 1] - base) + 1, np.uint64)
        np.cumsum((data[base : ends[j - 1]].astype(np.uint64) + np.uint64(1)) * up[: ends[j - 1] - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int, salt: int = 0x94D049BB133111EB) -> np.ndarray:
    """Hashes of n consecutive word hashes; the result is n-1 shorter."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size, out = len(words) - n + 1, np.zeros(len(words) - n + 1, np.uint64)
    factor = np.uint64(salt)
    for k in range(n):
        out = out * factor + words[k : k + size]
    return mix(out)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` (one each word) by document, given the index of each document's first word."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def arrow_column(make: Callable[[], Callable[[pa.Array], pa.Array]], returns: str, cut: bool = True) -> Callable[..., Column]:
    """A column function over texts in Arrow batches; `make` builds, once a task, what turns a batch into its results.

    Results are sent on piece by piece, so that a worker never holds those of a whole batch (`cut`: the column holds texts). It counts as nondeterministic so that the optimizer neither repeats it nor moves filters on its results below it.
    """

    def step(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = make()
        for batch in batches:
            for piece in pieces(batch) if cut else [batch]:
                yield run(piece)

    step.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(step, returns).asNondeterministic()
