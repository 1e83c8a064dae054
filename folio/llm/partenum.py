"""N-gram Jaccard join by PartEnum signatures.

Sets are put into bands of sizes: band i holds sizes from l to r = floor(l * OF / LEAST), so that sets that agree enough
lie in one band or in two next to each other, and differ in at most 2 * r * (OF - LEAST) / (OF + LEAST) elements, r being
the end of the greater one's band. Each set gets signatures for its own band and for the next one.

For a band with threshold k the domain of shingles is dealt by hash to groups of parts, and every subset of a group's
parts but one is a signature, with the set's elements in these parts. Of two sets within k some group holds at most one
differing part, so that they share a signature: with g groups at least 2 * g - k of them. There are more groups than
that needs, and a set leaves out its 2 * g - k - 1 signatures of fewest elements, which say least. Signatures that two sets share
have equal numbers of elements and equal places, so that the greatest of them in this order is left out by neither.

A signature that at most FEW values (distinct sets) have joins each of them with each. One of more values joins them as a star
to the least: first among those that a task holds, then among the tasks' least ones, so that a signature of any number of
sets costs in proportion to them and no task gets them all. Pairs are compared by parities (a bit of a value says
whether an odd number of its shingles fall to the bit's place, so that two values differ in as many shingles at least as in
bits), what is left by exact sets. Where a star's pair stays in two components, other values of the star may agree across
these: all values of such components are compared by prefixes of their sets, from rare shingles to common ones
(near_copies.across). A pair that is left out has no signature in common or lies in one component.

Defined results: words are lower-cased (A-Z) bytes between white space; with fewer words than SHINGLE the whole sequence is the
one shingle; a text without words, null texts included, has no shingle and is linked with nothing; a component's id is its
least non-null id (null where it has none); rows that repeat an id or a text each get their row; a text of any length is
taken whole; an empty table gives no rows; other columns may be there, whatever their names. Values are known by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import LOWER, WORD_BYTES, Chunk, arrow_column, checkpoint, chunks, gram_hashes, mix, release, span_hashes, word_bounds
from folio.llm.graph import components
from folio.llm.near_copies import LEAST, OF, SHINGLE, across, only, sets, value_of, verified
from folio.llm.simhash import BROADCAST_IDS

#: Up to this threshold groups have three parts and signatures two of them; beyond it two parts and one.
FINE = 12
#: A band has fewer groups than its threshold by one in so many; half as many groups are needed.
GROUPS = 8
#: Signatures that a task of the second step holds, and that one of the first step holds before it sends them on.
BUCKET, HELD = 1 << 20, 1 << 19
#: Values of a signature up to which each meets each.
FEW = 16
#: Bits of a value's parities, and values whose parities are made at a time.
PARITIES, SOME = 2048, 512


@dataclass(frozen=True)
class Band:
    """Sizes first to last, the threshold, groups, parts of a group, and signatures that a set leaves out."""

    first: int
    last: int
    threshold: int
    groups: int
    parts: int
    without: int


@lru_cache
def bands(size: int) -> list[Band]:
    """All bands up to the one after that of `size`."""
    out, first = [], 1
    while not out or len(out) < 2 or out[-2].last < size:
        last = first * OF // LEAST
        threshold = 2 * last * (OF - LEAST) // (OF + LEAST)
        groups = threshold + 1 - threshold // GROUPS
        out.append(Band(first, last, threshold, groups, 3 if threshold <= FINE else 2, 2 * groups - threshold - 1))
        first = last + 1
    return out


class Bands:
    """The bands as columns, for sizes up to a power of two."""

    def __init__(self) -> None:
        self.upto = 0

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """Each size's band."""
        most = int(sizes.max(initial=1))
        if most > self.upto:
            self.upto = 1 << most.bit_length()
            found = bands(self.upto)
            self.last, self.first, self.threshold, self.groups, self.parts, self.without = (np.array([getattr(b, f) for b in found], np.int64) for f in ("last", "first", "threshold", "groups", "parts", "without"))
        return np.searchsorted(self.last, sizes)

    def tagged(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets (places) and bands for which they get signatures: their own, and the next where a partner can lie there."""
        own = self.of(sizes)
        far = sizes * OF // LEAST >= self.first[own + 1]
        at, band = np.concatenate((np.arange(len(sizes)), np.flatnonzero(far))), np.concatenate((own, own[far] + 1))
        use = (self.threshold[band] > 0) & (sizes[at] > 0)  # equal sets are one value, none has no partner
        return at[use], band[use]

    def number(self, sizes: np.ndarray) -> int:
        """The signatures of sets of these sizes."""
        _, band = self.tagged(sizes)
        return int((self.groups[band] * self.parts[band] - self.without[band]).sum())


def shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of a chunk's documents, end to end, and their numbers."""
    data = LOWER[chunk.data]
    starts, ends, first = word_bounds(data, chunk.offsets, WORD_BYTES)
    words = span_hashes(data, starts, ends)
    found = [np.unique(gram_hashes(words[a:b], min(SHINGLE, b - a))) if b > a else words[:0] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return np.concatenate(found), np.array([len(x) for x in found], np.int64)


def signatures(elements: np.ndarray, sizes: np.ndarray, known: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets that lie end to end in `elements`, and the set of each."""
    at, band = known.tagged(sizes)
    if not len(at):
        return elements[:0], at
    begin = np.concatenate(([0], np.cumsum(sizes)))
    width = known.groups[band] * known.parts[band]
    base = np.concatenate(([0], np.cumsum(width)))
    # every tag's elements, one after the other
    n = sizes[at]
    row = np.repeat(np.arange(len(at)), n)
    place = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n) + begin[at][row]
    drawn = mix(elements[place] + (band[row].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    slot = base[row] + ((drawn >> np.uint64(32)) * width[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    sums, counts = np.zeros(base[-1], np.uint64), np.bincount(slot, minlength=base[-1])
    np.add.at(sums, slot, mix(drawn))
    # a part's place within its tag, and the tag, for each slot
    tag = np.repeat(np.arange(len(at)), width)
    part = np.arange(base[-1]) - base[tag]
    fine = known.parts[band][tag] == 3
    # of three parts a signature takes this one and the next around the group; of two parts this one alone
    step = np.where(part % 3 == 2, -2, 1)
    other = np.where(fine, np.arange(base[-1]) + step, 0)
    value = sums * np.uint64(0xA24BAED4963EE407) + np.where(fine, sums[other] * np.uint64(0x9FB21C651E98DF25), np.uint64(0))
    value = mix(value + mix((band[tag].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64) + np.uint64(1)))
    number = np.minimum(counts + np.where(fine, counts[other], 0), 255)
    order = np.argsort(tag << 8 | number, kind="stable")
    keep = order[np.arange(base[-1]) - base[tag] >= known.without[band][tag]]
    return value[keep], at[tag[keep]]


def _values(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each set's name, as near_copies names sets."""
    ends = np.cumsum(sizes)
    return np.array([value_of(elements[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)], np.int64)


def _named(texts: pa.Array) -> pa.Array:
    values, sizes = [], []
    for c in chunks(texts):
        elements, n = shingles(c)
        values.append(_values(elements, n))
        sizes.append(n)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))], ["fp", "size"])


def named(text: Column) -> Column:
    """fp and size of a text's set of shingles."""
    return arrow_column(lambda: _named, "struct<fp: long, size: long>")(text)


def _parities(texts: pa.Array) -> pa.Array:
    values, parities = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in chunks(texts):
        elements, n = shingles(c)
        values.append(_values(elements, n))
        begin, bit = np.concatenate(([0], np.cumsum(n))), (mix(elements) >> np.uint64(40)).astype(np.int64) % PARITIES
        for lo in range(0, len(n), SOME):
            few = n[lo : lo + SOME]
            place = np.repeat(np.arange(len(few)) * PARITIES, few) + bit[begin[lo] : begin[lo + len(few)]]
            odd = (np.bincount(place, minlength=len(few) * PARITIES) & 1).astype(np.uint8)
            parities.append(np.packbits(odd, bitorder="little").view(np.int64))
    found, width = np.concatenate(values), PARITIES // 64
    bits = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) * width + 1, width, dtype=np.int32)), pa.array(np.concatenate(parities)))
    return pa.StructArray.from_arrays([pa.array(found), bits], ["fp", "parities"])


def parities(text: Column) -> Column:
    """fp and parities of a text's set."""
    return arrow_column(lambda: _parities, "struct<fp: long, parities: array<long>>")(text)


@dataclass
class Met:
    """What shares signatures: pairs u > v, `crowded` where they are a star's, and signatures with values that others may have."""

    signature: np.ndarray
    value: np.ndarray
    many: np.ndarray
    u: np.ndarray
    v: np.ndarray


def meet(signature: np.ndarray, value: np.ndarray, many: np.ndarray, last: bool) -> tuple[Met, np.ndarray, np.ndarray]:
    """Signatures with their values, met: what is to be met elsewhere with the stars' pairs, and (if `last`) few values' pairs.

    `many` says of a signature's value that it stands for a star.
    """
    order = np.lexsort((value, signature))
    signature, value, many = signature[order], value[order], many[order]
    head = np.ones(len(signature), bool)
    head[1:] = (signature[1:] != signature[:-1]) | (value[1:] != value[:-1])
    places = np.flatnonzero(head)
    many = np.logical_or.reduceat(many, places) if len(places) else many
    signature, value = signature[places], value[places]
    first = np.ones(len(signature), bool)
    first[1:] = signature[1:] != signature[:-1]
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, len(signature)))
    star = (size > FEW) | ((size > 1) & np.logical_or.reduceat(many, starts)) if len(starts) else np.zeros(0, bool)
    group = np.repeat(np.arange(len(starts)), size)
    lesser = np.repeat(value[starts], size)
    arm = star[group] & (value != lesser)
    stars = np.unique(np.stack((value[arm], lesser[arm])), axis=1) if arm.any() else np.zeros((2, 0), np.int64)
    sent = ~arm
    few_u, few_v = [], []
    if last:
        for apart in range(1, FEW):  # each value with those that stand so many places before it
            at = np.flatnonzero((group[apart:] == group[:-apart]) & ~star[group[apart:]]) + apart
            few_u.append(value[at])
            few_v.append(value[at - apart])
        few = np.unique(np.stack((np.concatenate(few_u), np.concatenate(few_v))), axis=1)
    else:
        few = np.zeros((2, 0), np.int64)
    return Met(signature[sent], value[sent], (many | star[group])[sent], *stars), *few


_BLOCKS = "bucket int, signatures binary, owners binary, many binary, u binary, v binary"


def _dealt(buckets: int):
    """A mapper from texts to blocks of signatures, with the values that the task holds of each, and of stars' pairs."""

    def blocks(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        signature = np.concatenate([s for s, _ in held])
        met, _, _ = meet(signature, np.concatenate([f for _, f in held]), np.zeros(len(signature), bool), False)
        sides = []
        for key, columns in ((met.signature, (met.signature, met.value, met.many)), (met.u.view(np.uint64), (met.u, met.v))):
            to = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            for x in columns:
                data, size = x[order].tobytes(), x.itemsize
                sides.append([data[size * a : size * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        some = [i for i in range(buckets) if sides[0][i] or sides[3][i]]
        return pa.record_batch([pa.array(some, pa.int32()), *(pa.array([s[i] for i in some], pa.binary()) for s in sides)], names=["bucket", "signatures", "owners", "many", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Bands(), [], 0
        for batch in batches:
            for c in chunks(batch.column(0)):
                elements, n = shingles(c)
                found, owner = signatures(elements, n, known)
                held.append((found, _values(elements, n)[owner]))
                size += len(found)
                if size > HELD:
                    yield blocks(held)
                    held, size = [], 0
        if size:
            yield blocks(held)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of all blocks of a partition, those that came along included."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for batch in batches:
        for part, name, kind in zip(parts, ("signatures", "owners", "many", "u", "v"), (np.uint64, np.int64, np.bool_, np.int64, np.int64), strict=True):
            part.extend(np.frombuffer(x, kind) for x in batch.column(name).to_pylist())
    if not parts[0]:
        return
    signature, owner, many, u, v = (np.concatenate(p) for p in parts)
    parts.clear()
    met, few_u, few_v = meet(signature, owner, many, True)
    for crowded, x, y in ((True, np.concatenate((u, met.u)), np.concatenate((v, met.v))), (False, few_u, few_v)):
        pairs = np.unique(np.stack((x, y)), axis=1)
        for lo in range(0, pairs.shape[1], 1 << 16):
            some = [pa.array(p[lo : lo + (1 << 16)]) for p in pairs]
            yield pa.record_batch([*some, pa.array(np.full(len(some[0]), crowded))], names=["u", "v", "crowded"])


def candidates(texts: DataFrame, number: int) -> DataFrame:
    """Distinct pairs u > v of values that share a signature, as stars or each with each, and whether a star's is among them.

    `number`: about how many signatures there are.
    """
    buckets = max(1, -(-number // BUCKET))
    met = texts.mapInArrow(_dealt(buckets), _BLOCKS).repartitionById(buckets, F.col("bucket")).mapInArrow(_met, "u long, v long, crowded boolean")
    return met.groupBy("u", "v").agg(F.bool_or("crowded").alias("crowded"))


def _read(docs: DataFrame, members: DataFrame, function, columns: list[str]) -> DataFrame:
    """A function's result for each of the members' values (fp, least), from the texts of their least ids."""
    wanted = members.select(F.col("least").alias("wanted")).distinct()
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select(function(F.col("text")).alias("s"))
    own = found.select(*(f"s.{c}" for c in columns)).join(members.select("fp"), "fp", "left_semi")  # an id may have several texts
    out = checkpoint(own.dropDuplicates(["fp"]))
    release(docs.sparkSession)
    return out


def _ends(pairs: DataFrame, members: DataFrame) -> DataFrame:
    return checkpoint(members.join(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "fp"))


def links(docs: DataFrame, values: DataFrame, number: int) -> DataFrame:
    """Links u > v that connect the values (fp, size, least) of docs (doc_id, text) as all pairs that agree enough would."""
    pairs = checkpoint(candidates(docs.select("text"), number))
    members = _ends(pairs, values.select("fp", "size", "least"))
    marks = checkpoint(members.select("fp", "size").join(_read(docs, members, parities, ["fp", "parities"]), "fp"))
    alike = checkpoint(_alike(pairs, marks))
    linked = checkpoint(verified(alike, _read(docs, _ends(alike, members), sets, ["fp", "shingles"])))
    release(docs.sparkSession)
    rooted = members.select("fp").join(components(linked).select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    of = lambda name: rooted.select(F.col("fp").alias(name), F.col("root").alias(f"root_{name}"))
    split = pairs.where("crowded").join(of("u"), "u").join(of("v"), "v").where("root_u <> root_v").select(F.explode(F.array("root_u", "root_v")).alias("root")).distinct()
    apart = checkpoint(rooted.join(split, "root").select("fp", "root"))
    known = _read(docs, members.join(apart, "fp", "left_semi"), sets, ["fp", "shingles"])

    def verify(pairs: DataFrame) -> DataFrame:
        met = checkpoint(pairs)
        likely = checkpoint(_alike(met, only(marks, met)))
        return verified(likely, only(known, likely))

    return linked.unionByName(across(apart, members, known, verify))


def _alike(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs whose sizes and parities allow them to agree enough."""
    of = lambda name: marks.select(F.col("fp").alias(name), F.col("size").alias(f"size_{name}"), F.col("parities").alias(f"parities_{name}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    odd = F.aggregate(F.zip_with("parities_u", "parities_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    sizes = F.least("size_u", "size_v") * OF >= F.greatest("size_u", "size_v") * LEAST
    return both.where(sizes & (odd * (OF + LEAST) <= (F.col("size_u") + F.col("size_v")) * (OF - LEAST))).select("u", "v")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = checkpoint(given.select("doc_id", named(F.col("text")).alias("s")).select("doc_id", "s.fp", "s.size"))
    known, number = Bands(), 0
    for r in rows.groupBy(F.floor(F.log2(F.greatest("size", F.lit(1))) * 8).alias("step")).agg(F.count("*").alias("n"), F.max("size").alias("most")).collect():
        number += r.n * known.number(np.array([r.most]))
    values = checkpoint(rows.where("size > 0").groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.first("size").alias("size")))
    found = components(links(given, values, number)).select(F.col("node").alias("fp"), "root")
    rooted = values.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1")
    # only values of several rows need be looked up; a value of very many rows is one that the planner splits
    mapped = checkpoint(rooted.join(least, "root").select("fp", "component_id", F.lit(True).alias("shared")))
    # rows without a shingle look nothing up, and are spread by their ids
    looked = rows.withColumn("fp", F.when(F.col("size") > 0, F.col("fp")).otherwise(F.xxhash64("doc_id"))).join(mapped, "fp", "left")
    return looked.select("doc_id", F.col("size").alias("n_shingles"), F.when((F.col("size") > 0) & F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
