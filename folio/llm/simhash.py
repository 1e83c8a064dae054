"""SimHash near-duplicate groups found by covering locality-sensitive hashing.

Every bit place of a fingerprint gets a non-zero vector of radius + 1 bits; table v keeps the places whose vector has
an odd product with v. The places at which two fingerprints within the radius differ span less than the whole space,
so that some v is orthogonal to all of them: such a pair always collides in some table.

Within a table's bucket, fingerprints within two bits of each other share a value at one bit from both (or are one bit
apart); each fingerprint is sent to its values over the bits that the table leaves free, and those that meet are
linked to the least of them. So a bucket of any size costs in proportion to its members, and no pairs are written.
Components of the links come from alternating large and small stars; copies were folded into one fingerprint before.

Defined results: a text without words, null texts included, has fingerprint zero and is linked like any other; a text
of fewer than three words is one shingle; repeated rows fall into one component; the component is the least non-null
id in it (null if all ids are null); other columns are kept, and one that is named as the result is replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import arrow_column, checkpoint, chunks, fresh
from folio.llm.graph import components

#: Bits in which linked fingerprints may differ. The star values within buckets are made for two.
RADIUS = 2
#: A fingerprint with over 1/HOT_SHARE of all rows is joined by broadcast; there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Parts into which a bucket's fingerprints are dealt for the join with their bucket.
SALTS = 8
#: Ids that are broadcast at most: about 32 MB.
BROADCAST_IDS = 1_000_000
SHINGLE, SEED = 3, 42


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one whole text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_batch(texts: pa.Array) -> pa.Array:
    found = np.fromiter((fingerprint(c.data[a:b].tobytes()) for c in chunks(texts) for a, b in itertools.pairwise(c.offsets.tolist())), np.uint64, len(texts))
    return pa.array(found.view(np.int64))


def fingerprints(text: Column) -> Column:
    """Fingerprints as signed 64-bit integers."""
    return arrow_column(lambda: fingerprint_batch, "long")(text)


def masks(radius: int = RADIUS, seed: int = 1) -> list[int]:
    """Bits kept by each of the 2^(radius+1) - 1 tables: a covering family for `radius` over 64 places."""
    order = np.random.default_rng(seed).permutation(64)
    top = (1 << (radius + 1)) - 1
    vectors = {int(place): 1 + i % top for i, place in enumerate(order)}
    return [sum(1 << p for p, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(values: DataFrame) -> DataFrame:
    """Links u > v (columns u, v) that connect all distinct values of column fp within two bits of each other."""
    if RADIUS != 2:
        raise ValueError("values at one bit from both ends reach pairs within two bits only")
    kept = masks()
    keyed = values.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(kept)))).alias("k")).select("fp", "k.t", "k.key")
    met = keyed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("t", "key", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    inside = keyed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(met, ["t", "key", "salt"]).select("t", "key", "fp")
    free = F.element_at(F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << p)) for p in range(64) if not m >> p & 1)) for m in kept)), F.col("t") + 1)
    near = inside.select("t", "fp", F.explode(F.transform(free, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("value"))
    stars = near.groupBy("t", "value").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("all"))  # at most 65 fit
    return stars.select("v", F.explode("all").alias("u")).where("u <> v").select("u", "v").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = checkpoint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprints(F.col(f"`{text}`")).alias("fp")))
    values = checkpoint(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    return assign(rows, values, components(links(values.select("fp"))))


def assign(rows: DataFrame, values: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc_id, fp) with component_id, given their values (fp, n, least) and the components found of those."""
    of = found.select(F.col("node").alias("fp"), "root")
    rooted = values.join(of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size"))
    # only fingerprints in components of several rows need to be looked up
    mapped = checkpoint(rooted.join(least.where("size > 1"), "root").select("fp", "n", "component_id"))
    total = rows.count()
    hot = F.broadcast(mapped.where(F.col("n") * HOT_SHARE > F.lit(total)).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")))
    rest = mapped.where(F.col("n") * HOT_SHARE <= F.lit(total)).select("fp", F.col("component_id").alias("rest_id"), F.lit(True).alias("is_rest"))
    first = rows.join(hot, "fp", "left")
    # rows that are answered, and rows without partners by their own id, are spread over all partitions of the second join
    second = first.withColumn("look", F.when(F.col("is_hot"), F.lit(None).cast("long")).otherwise(F.col("fp")))
    done = second.where(F.col("look").isNull()).select("doc_id", "fp", F.col("hot_id").alias("component_id"))
    looked = second.where(F.col("look").isNotNull()).join(rest, "fp", "left").select("doc_id", "fp", F.when(F.col("is_rest"), F.col("rest_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return done.unionByName(looked)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `docs` whose id is the least of its component.

    A row with a null id stays only where no other id is in its component; rows that repeat the id that stays all do.
    """
    return stay(docs, near_duplicates(docs, doc_id, text), doc_id)


def stay(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows of `docs` whose id is the least of its component in `groups`.

    The ids that go are broadcast while they are BROADCAST_IDS at most, so that texts aren't shuffled.
    """
    (name,) = fresh(docs, "__stay")
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = checkpoint(groups.groupBy(F.col("doc_id").alias(name)).agg(F.max(least).alias("stays")).where("NOT stays").select(name))
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(name)), "left_anti")
