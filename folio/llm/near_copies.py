"""Near copies: documents whose sets of five-word shingles have a Jaccard index of at least 0.8.

Texts with equal sets are folded into one value. Values meet by SimHash first, as operator 4 links fingerprints within two
bits by its covering masks, and what it links is checked by exact sets. Copies at 0.8 may lie further apart (3 to 11 bits of
64), so that values meet by MinHash as well: each has BANDS keys of ROWS minima, and a pair
at 0.8 shares none with probability (1 - 0.8^5)^32, 3 in a million. What meets is compared by exact shingle sets: each
value of a bucket with that of its values that meets most others; then values of buckets that lie in several components
are compared across these where prefixes of their sets, from rare shingles to common ones, allow 0.8. A pair left out is
in one component already or below 0.8, so components are those of all pairs that share a key. A large group costs in
proportion to its members: edited copies of one text that stay apart have their own shingles in the prefixes. Sets are
read only for pairs whose sizes allow 0.8 and whose minima differ in at most FAR of 160 bits (16 expected at 0.8).

Defined results: words are lower-cased (A-Z) bytes between white space; a text of fewer than five words is one shingle;
texts without words, null texts included, are copies of each other; a component's id is its least non-null id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm import simhash
from folio.llm.common import LOWER, WORD_BYTES, arrow_column, checkpoint, chunks, gram_hashes, mix, release, span_hashes, word_bounds
from folio.llm.graph import components
from folio.llm.simhash import BROADCAST_IDS, assign, stay

#: The definition: words a shingle, and the least Jaccard index as a fraction.
SHINGLE, LEAST, OF = 5, 4, 5
#: Keys of a value and minima in a key.
BANDS, ROWS = 32, 5
#: Bits of the minima in which a pair that is compared may differ.
FAR = 40
#: Shingles whose minima are taken at a time.
PIECE = 512
#: Rounds in which a shingle's values meet one of them, before those of several components meet each other.
ROUNDS = 1
#: Parts into which the pairs of a value are dealt when its set is joined to them.
SALTS = 8
_RANDOM = np.random.default_rng(7).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
FACTORS, TERMS = _RANDOM[0] | np.uint64(1), _RANDOM[1]


def shingle_sets(texts: pa.Array):
    """The sorted distinct shingle hashes of each text."""
    for c in chunks(texts):
        data = LOWER[c.data]
        starts, ends, first = word_bounds(data, c.offsets, WORD_BYTES)
        words = span_hashes(data, starts, ends)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(gram_hashes(words[a:b], min(SHINGLE, b - a))) if b > a else np.zeros(1, np.uint64)


def value_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def _keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, and a bit of each minimum in three integers."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for lo in range(0, len(shingles), PIECE):
        least = np.minimum(least, (shingles[lo : lo + PIECE] * FACTORS + TERMS).min(axis=1))
    keys = np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    # the lowest bit of a product is that of the shingle; the mixed minimum's isn't
    bits = np.zeros(192, np.uint8)
    bits[: BANDS * ROWS] = (mix(least) & np.uint64(1)).astype(np.uint8)
    return keys.view(np.int64), np.packbits(bits, bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _sketches(texts: pa.Array) -> pa.Array:
    values, sizes, keys, bits = [], [], [], []
    for s in shingle_sets(texts):
        values.append(value_of(s))
        sizes.append(len(s))
        k, b = _keys(s)
        keys.append(k)
        bits.append(b)
    three = np.array(bits, np.int64).reshape(-1, 3).T
    return pa.StructArray.from_arrays([pa.array(values, pa.int64()), pa.array(sizes, pa.int64()), _lists(keys), *map(pa.array, three)], ["fp", "size", "keys", "b0", "b1", "b2"])


def _sets(texts: pa.Array) -> pa.Array:
    sets = list(shingle_sets(texts))
    return pa.StructArray.from_arrays([pa.array([value_of(s) for s in sets], pa.int64()), _lists([s.view(np.int64) for s in sets])], ["fp", "shingles"])


def sketches(text: Column) -> Column:
    return arrow_column(lambda: _sketches, "struct<fp: long, size: long, keys: array<long>, b0: long, b1: long, b2: long>")(text)


def _marks(texts: pa.Array) -> pa.Array:
    found = _sketches(texts)
    return pa.StructArray.from_arrays([*found.flatten(), simhash.fingerprint_batch(texts)], [*(f.name for f in found.type), "simhash"])


def marks(text: Column) -> Column:
    """Sketches with SimHash fingerprints; as two functions they would have two Python workers in each task."""
    return arrow_column(lambda: _marks, "struct<fp: long, size: long, keys: array<long>, b0: long, b1: long, b2: long, simhash: long>")(text)


def sets(text: Column) -> Column:
    return arrow_column(lambda: _sets, "struct<fp: long, shingles: array<long>>")(text)


def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct pairs u > v whose shingle sets agree enough; a set goes to as many salts as it has pairs in."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
    lesser = pairs.select(F.col("v").alias("fp"), "salt").distinct().join(known, "fp").select(F.col("fp").alias("v"), "salt", F.col("shingles").alias("x"))
    both = pairs.join(known.select(F.col("fp").alias("u"), F.col("shingles").alias("y")), "u").join(lesser, ["v", "salt"])
    met = F.size(F.array_intersect("x", "y"))
    return both.where((OF + LEAST) * met >= LEAST * (F.size("x") + F.size("y"))).select("u", "v")


def only(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of a table of values that checkpointed pairs name, without a shuffle of the others while those are few."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    return table.join(F.broadcast(ends), "fp", "left_semi") if ends.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else table


def _plausible(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (u, v) that can agree enough by their sizes and minima."""
    of = lambda name: members.select(F.col("fp").alias(name), F.struct("size", "b0", "b1", "b2").alias(f"of_{name}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    apart = sum((F.bit_count(F.col(f"of_u.{b}").bitwiseXOR(F.col(f"of_v.{b}"))) for b in ("b0", "b1", "b2")), F.lit(0))
    alike = F.least("of_u.size", "of_v.size") * OF >= F.greatest("of_u.size", "of_v.size") * LEAST
    return both.where(alike & (apart <= FAR)).select("u", "v")


def _checked(pairs: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    met = checkpoint(pairs)
    likely = checkpoint(_plausible(met, only(members, met)))
    return verified(likely, only(known, likely))


def _heads(rooted: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """The prefixes of values (fp, root) with the places of their shingles: fp, root, size, weight, at, shingle.

    In an order of shingles from rare to common, two sets that agree enough share one in their prefixes of size -
    ceil(size * LEAST / OF) + 1, and what follows the first that they share must be enough still. A value's weight says how
    many others have its shingles; among edited copies of a text that is the text's own.
    """
    # exploded twice rather than written: the sets are a checkpoint already
    each = checkpoint(known.join(rooted, "fp", "left_semi")).select("fp", F.explode("shingles").alias("shingle"))
    counted = each.groupBy("shingle").agg(F.count("*").alias("n"))
    # shingles of one value come first and meet nothing, so that only their number counts
    shared = each.join(counted.where("n > 1"), "shingle")
    ranked = shared.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("order"))
    alone = F.col("size") - F.size("order")
    prefix = F.col("size") - F.ceil(F.col("size") * LEAST / OF) + 1 - alone
    weight = F.aggregate("order", F.lit(0).cast("double"), lambda total, x: total + x["n"]) / F.col("size")
    heads = ranked.join(rooted.join(members.select("fp", "size"), "fp"), "fp").where(prefix > 0).select("fp", "root", "size", weight.alias("weight"), F.posexplode(F.slice("order", F.lit(1), prefix.cast("int"))).alias("at", "x"), alone.alias("alone"))
    return checkpoint(heads.select("fp", "root", "size", "weight", (F.col("at") + F.col("alone")).alias("at"), F.col("x.shingle").alias("shingle")))


def _enough(other: str) -> Column:
    """Whether a head and another's, of the same shingle, can agree enough: by sizes, and by what follows in both."""
    sizes = (F.least("size", f"{other}.size") * OF >= F.greatest("size", f"{other}.size") * LEAST) & (F.col("root") != F.col(f"{other}.root"))
    rest = F.least(F.col("size") - F.col("at"), F.col(f"{other}.size") - F.col(f"{other}.at"))
    return sizes & (rest * (OF + LEAST) >= (F.col("size") + F.col(f"{other}.size")) * LEAST)


def _pairs(met: DataFrame, other: str) -> DataFrame:
    return met.where(_enough(other)).select(F.greatest("fp", f"{other}.fp").alias("u"), F.least("fp", f"{other}.fp").alias("v")).distinct()


def across(rooted: DataFrame, members: DataFrame, known: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links u > v that `verify` leaves of pairs of values (fp, root) of different components that can agree enough.

    At first each shingle's values meet only the one of them that weighs most, and components grow by what is linked. Then those of a shingle that are outside the component that has most of them are compared with all, so that
    a large group of copies, which the rounds have put together, isn't compared pair by pair.
    """
    heads, found = _heads(rooted, members, known), None
    for _ in range(ROUNDS):
        one = F.max(F.struct("weight", "fp", "root", "size", "at")).alias("one")
        ones = heads.groupBy("shingle").agg(one, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle", "one")
        linked = checkpoint(verify(_pairs(heads.join(ones, "shingle"), "one")))
        found = linked if found is None else found.unionByName(linked)
        if linked.isEmpty():
            break
        roots = checkpoint(heads.select("fp", "root").distinct())
        of = lambda name: roots.select(F.col("fp").alias(name), F.col("root").alias(f"root_{name}"))  # noqa: E731, B023
        joined = linked.join(of("u"), "u").join(of("v"), "v").select(F.greatest("root_u", "root_v").alias("u"), F.least("root_u", "root_v").alias("v")).where("u <> v").distinct()
        moved = components(joined).select(F.col("node").alias("root"), F.col("root").alias("now"))
        grown = roots.join(moved, "root").select("fp", "now")
        heads = checkpoint(heads.join(grown, "fp", "left").withColumn("root", F.coalesce("now", "root")).drop("now"))
        release(heads.sparkSession)
    parts = heads.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    all_ = heads.join(parts, "shingle")
    few = all_.where("root <> most").select("shingle", F.struct("fp", "root", "size", "at").alias("few"))
    return found.unionByName(verify(_pairs(few.join(all_.select("shingle", "fp", "root", "size", "at"), "shingle"), "few")))


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """Pairs u > v of values (fp) of rows (fp, simhash) whose fingerprints are equal or linked by operator 4; a fingerprint's values meet its least."""
    held = checkpoint(rows.select("simhash", "fp").distinct())
    heads = checkpoint(held.groupBy("simhash").agg(F.min("fp").alias("head")))
    equal = held.join(heads, "simhash").select("fp", "head")
    of = lambda name: heads.select(F.col("simhash").alias(name), F.col("head").alias(f"of_{name}"))
    near = simhash.links(heads.select(F.col("simhash").alias("fp"))).join(of("u"), "u").join(of("v"), "v").select(F.col("of_u").alias("fp"), F.col("of_v").alias("head"))
    return equal.unionByName(near).where("fp <> head").select(F.greatest("fp", "head").alias("u"), F.least("fp", "head").alias("v")).distinct()


def links(docs: DataFrame, values: DataFrame, rows: DataFrame) -> DataFrame:
    """Links u > v that connect the values (fp, size, keys, b0, b1, b2, least) of docs (doc_id, text) with rows (fp, simhash)."""
    first = checkpoint(simhash_pairs(rows))
    release(docs.sparkSession)
    keyed = values.select("fp", F.explode("keys").alias("key")).repartition("key")
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    inside = checkpoint(keyed.join(met, "key").withColumn("weight", F.sum("n").over(W.partitionBy("fp"))).drop("n"))
    asked = inside.select("fp").unionByName(first.select(F.explode(F.array("u", "v")).alias("fp"))).distinct()
    members = checkpoint(values.join(asked, "fp", "left_semi").select("fp", "least", "size", "b0", "b1", "b2"))
    wanted = members.select(F.col("least").alias("wanted")).distinct()
    found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select(sets(F.col("text")).alias("s"))
    known = checkpoint(found.select("s.fp", "s.shingles").dropDuplicates(["fp"]))
    release(docs.sparkSession)
    # each value of a bucket with the one that meets most others, in all of that one's buckets alike
    pivots = inside.groupBy("key").agg(F.max(F.struct("weight", "fp")).alias("p")).select("key", F.col("p.fp").alias("pivot"))
    pairs = inside.join(pivots, "key").where("fp <> pivot").select(F.greatest("fp", "pivot").alias("u"), F.least("fp", "pivot").alias("v")).distinct()
    # by SimHash, then by MinHash what it hasn't named
    linked = checkpoint(verified(_plausible(first.unionByName(pairs.join(first, ["u", "v"], "left_anti")), members), known))
    placed = inside.select("key", "fp").join(components(linked).select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    apart = checkpoint(placed.join(split, "key").select("fp", "root").distinct())
    release(docs.sparkSession)
    return linked.unionByName(across(apart, members, known, lambda pairs: _checked(pairs, members, known)))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (a digest of the shingle set) and component_id of every row."""
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = checkpoint(given.select("doc_id", marks(F.col("text")).alias("s")).select("doc_id", "s.*"))
    values = checkpoint(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "keys", "b0", "b1", "b2"))))
    return assign(rows.select("doc_id", "fp"), values.select("fp", "n", "least"), components(links(given, values, rows)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `docs` whose id is the least of its component, by the rules of simhash.keep_one."""
    return stay(docs, near_copies(docs, doc_id, text), doc_id)
