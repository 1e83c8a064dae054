"""Benchmark decontamination by winnowing.

Each side keeps the least k-gram hash of every sliding window of w k-grams, so that any shared span of w + k - 1 words
leaves at least one equal fingerprint on both sides. Where a document's fingerprint is one of the benchmark's, the
windows around it are candidates; consecutive ones are one run of words. Equal runs of all documents are folded, their
windows joined with the benchmark's, and what is found goes back to the documents that hold them. Items of fewer words
than a window are windows of their own length, looked up at every place.

Neither side is gathered anywhere: the benchmark's windows are rows of a table. What every task gets of it is a bit map
of the hashes of its fingerprints and windows, 2^MOST_BITS bits at most whatever its size; it keeps back nearly all
places that can't match, and the join decides about the rest by the windows' digests. Documents are read twice and not
shuffled while what was found is BROADCAST_BYTES at most; beyond, they are joined with it by a digest of their text.

Defined results: a null or wordless text has no words and is clean; an item without words, a null item and an item
whose id is null are ignored; items of equal text all count; repeated rows get equal results; ties between equal
hashes keep all of them; a text of any length is one row, cut into runs only where it may match; an empty benchmark finds
nothing; other columns are kept, and one that is named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ALNUM_BYTES, LOWER, arrow_column, checkpoint, chunks, fresh, gram_hashes, span_hashes, word_bounds

#: Words of a window, and of a k-gram; fingerprints are minima over WINDOW - GRAM + 1 k-grams.
WINDOW, GRAM = 10, 5
#: Bits of the map as a power of two, least and most (16 MB), and bits a hash where there is room.
LEAST_BITS, MOST_BITS, ROOM = 16, 27, 64
#: What was found is broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20
_TO_WORDS = bytes(LOWER[b] if ALNUM_BYTES[b] else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text."""
    return (text or "").encode().translate(_TO_WORDS).split()


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """True where a k-gram hash is the least of some window of `width`; ties are all kept, short input wholly."""
    n = len(grams)
    if n < width:
        return np.full(n, n > 0) & (grams == grams.min(initial=np.iinfo(np.uint64).max))
    low = grams[: n - width + 1].copy()
    for k in range(1, width):
        np.minimum(low, grams[k : n - width + 1 + k], out=low)
    high = np.zeros(n, np.uint64)
    for k in range(width):
        np.maximum(high[k : n - width + 1 + k], low, out=high[k : n - width + 1 + k])
    return high == grams


def _item_batch(texts: pa.Array) -> pa.Array:
    """Words of each item in one string, the words of its windows, and the hashes of its fingerprints and windows."""
    joined, sizes, found = [], [], []
    for text in texts.to_pylist():
        words = words_of(text)
        size = min(WINDOW, len(words))
        hashes = _word_hashes(words)
        grams = gram_hashes(hashes, GRAM) if size == WINDOW else np.zeros(0, np.uint64)
        whole = gram_hashes(hashes, size) if size else grams
        joined.append(b" ".join(words))
        sizes.append(size)
        found.append(np.unique(np.concatenate([grams[winnow(grams, WINDOW - GRAM + 1)], whole])).view(np.int64))
    return pa.StructArray.from_arrays([pa.array(joined, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["words", "size", "hashes"])


def _word_hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)


class Places:
    """Where a window of the benchmark may stand: a bit map of its hashes, and the lengths of its windows."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(65 - len(self.bits).bit_length() - 6)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def runs(self, texts: pa.Array) -> list[list[tuple[int, str, list[int]]]]:
        """For each text the runs of words that may hold windows: words of a window, the words, and their places."""
        return [x for c in chunks(texts) for x in self._chunk(c.data, c.offsets)]

    def _chunk(self, raw: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, str, list[int]]]]:
        data = LOWER[raw]
        starts, ends, first = word_bounds(data, offsets, ALNUM_BYTES)
        hashes = span_hashes(data, starts, ends)
        last = np.repeat(first[1:], np.diff(first))  # for each word the end of its document
        found: list[dict[tuple[int, bytes], list[int]]] = [{} for _ in range(len(first) - 1)]
        for size in self.sizes:
            whole = gram_hashes(hashes, size)
            at = self._near(hashes, last) if size == WINDOW else np.arange(len(whole))
            at = at[at + size <= last[at]]  # a window that starts in an earlier document than it ends in is none
            at = at[self.has(whole[at])]
            cut = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (last[at] != np.concatenate(([-1], last[at][:-1])))) if len(at) else at
            for a, b in zip(at[cut].tolist(), [*(at[cut[1:] - 1] + size).tolist(), *(at[-1:] + size).tolist()], strict=True):
                doc = int(np.searchsorted(first, a, "right")) - 1
                text = b" ".join(data[starts[a] : ends[b - 1]].tobytes().translate(_TO_WORDS).split())
                found[doc].setdefault((size, text), []).append(a - int(first[doc]))
        return [[(size, text.decode("utf-8", "replace"), places) for (size, text), places in x.items()] for x in found]

    def _near(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Starts of whole windows around the fingerprints that the benchmark may have too."""
        grams = gram_hashes(hashes, GRAM)
        if not len(grams):
            return np.zeros(0, np.int64)
        place = np.arange(len(grams))
        grams[place + GRAM > last[: len(grams)]] = np.iinfo(np.uint64).max  # across two documents
        own = np.flatnonzero(winnow(grams, WINDOW - GRAM + 1))
        own = own[self.has(grams[own])]
        at = np.unique((own[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
        return at[(at >= 0) & (at + WINDOW <= len(hashes))]


RUN = pa.struct([("size", pa.int32()), ("words", pa.string()), ("places", pa.list_(pa.int64()))])


def _runs(places: Broadcast) -> Callable[..., Column]:
    def make() -> Callable[[pa.Array], pa.Array]:
        return lambda texts: pa.array([[{"size": s, "words": w, "places": p} for s, w, p in x] for x in places.value.runs(texts)], pa.list_(RUN))

    return arrow_column(make, "array<struct<size: int, words: string, places: array<long>>>")


def _count_batch(texts: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.int64), *(np.diff(word_bounds(c.data, c.offsets, ALNUM_BYTES)[2]) for c in chunks(texts))]), pa.int64())


def merged(parts: list[dict]) -> list[dict]:
    """Spans of words from the places of runs and of windows in them; spans that touch are one."""
    begin, end = [], []
    for p in parts:
        at = (np.array(p["places"], np.int64)[:, None] + np.array(p["offsets"], np.int64)).ravel()
        begin.append(at)
        end.append(at + p["size"])
    begin, end = np.concatenate(begin), np.concatenate(end)
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    lead = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    return [{"start": a, "end": b} for a, b in zip(begin[lead].tolist(), reach[np.append(lead[1:] - 1, len(reach) - 1)].tolist(), strict=True)]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(parts: Column) -> Column:
    return arrow_column(lambda: lambda batch: pa.array([merged(p) for p in batch.to_pylist()], SPANS), "array<struct<start: long, end: long>>", cut=False)(parts)


def _windows(words: Column, size: Column) -> Column:
    """Digests of all windows of words in a string that single spaces part."""
    each = F.split(words, " ")
    return F.transform(F.sequence(F.lit(1), F.size(each) - size + 1), lambda i: F.md5(F.array_join(F.slice(each, i, size), " ")))


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """The map of the hashes as 64-bit words, made from as many rows at most."""
    n = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (ROOM * n).bit_length()))
    at = F.shiftrightunsigned("hash", 64 - bits)
    set_ = hashes.select(F.shiftright(at, 6).alias("word"), at.alias("at")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    rows = set_.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def found_in(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> DataFrame:
    """mark, spans and items of every distinct text of docs that holds a window; mark is the text's digest."""
    given = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("text")).dropna().distinct()
    items = checkpoint(given.select("id", arrow_column(lambda: _item_batch, "struct<words: string, size: int, hashes: array<long>>")(F.col("text")).alias("x")).select("id", "x.*").where("size > 0"))
    sizes = sorted(r.size for r in items.select("size").distinct().collect())
    places = docs.sparkSession.sparkContext.broadcast(Places(_bit_map(items.select(F.explode("hashes").alias("hash")).distinct()), [int(s) for s in sizes]))
    # runs of the documents, equal texts once
    runs = docs.select(F.col(f"`{text}`").alias("text")).withColumn("runs", _runs(places)(F.col("text"))).where(F.size("runs") > 0)
    held = runs.groupBy(F.sha2("text", 256).alias("mark")).agg(F.first("runs").alias("runs")).select("mark", F.inline("runs"))
    held = checkpoint(held.withColumn("run", F.sha2("words", 256)))
    # windows of different runs, joined with the benchmark's
    theirs = items.select("id", "size", F.explode(F.array_distinct(_windows(F.col("words"), F.col("size")))).alias("digest")).distinct()
    different = held.groupBy("run", "size").agg(F.first("words").alias("words"))
    ours = different.select("run", "size", F.posexplode(_windows(F.col("words"), F.col("size"))).alias("at", "digest"))
    answers = ours.join(theirs, ["size", "digest"]).groupBy("run", "size").agg(F.collect_set("at").alias("offsets"), F.collect_set("id").alias("ids"))
    back = held.select("mark", "run", "size", "places").join(answers, ["run", "size"]).groupBy("mark").agg(F.collect_list(F.struct("size", "places", "offsets")).alias("parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    return back.select("mark", _spans(F.col("parts")).alias("spans"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "decon", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add a struct `out`: n_words, the spans of words that are hit, and the sorted ids of the items found."""
    mark, spans, items = fresh(docs, "__mark", "__spans", "__items")
    found = checkpoint(found_in(docs, benchmark, text, item_id, item_text).toDF(mark, spans, items))
    size = found.agg(F.sum(F.lit(128) + 16 * F.size(spans) + F.aggregate(items, F.lit(0), lambda a, x: a + 16 + F.octet_length(x)))).first()[0] or 0
    t = F.col(f"`{text}`")
    n_words = arrow_column(lambda: _count_batch, "long")(t)
    joined = docs.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.sha2(t, 256) == F.col(mark), "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>"), F.array().cast("array<string>")
    return joined.withColumn(out, F.struct(n_words.alias("n_words"), F.coalesce(spans, none[0]).alias("spans"), F.coalesce(items, none[1]).alias("items"))).drop(mark, spans, items)


def hit_words(decon: str) -> Column:
    """Number of words that are hit."""
    return F.aggregate(F.col(decon).getField("spans"), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
