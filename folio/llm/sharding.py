"""Shuffled shards by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters rows over memory-sized buckets by a seeded hash, each sent straight to its bucket's partition, texts
once. Pass two puts each bucket in a drawn order and numbers it; buckets follow each other in one global order, whose
rows are dealt out to the shards in runs that differ by one row at most (the law `rows`). Buckets' first places come
from counts of hashed ids alone.

The order within a bucket is that of a second seeded hash of the row, which gives every order the same chance as a
Fisher-Yates shuffle does. Spark's own shuffle() draws from one generator a task in the order of arrival and needs a
bucket in one array: a bucket made again after a loss could get another order, and its rows had to fit on the heap.
The sort spills, and gives the same places for the same rows and seed however the input is split. A bucket has
BUCKET_BYTES, or more where there would be over MOST_BUCKETS.

Rows that repeat an id and a text share a bucket and are told apart by their other columns (but maps); rows that are
wholly equal are by nothing, and take neighbouring places in any order.

Defined results: a null text has size 1 and the CRC of an empty text; a null id is hashed like any other; a text of any
length is one row; an empty table gives empty shards; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a bucket, and buckets: as many partitions of the scatter and rows of the broadcast first places.
BUCKET_BYTES, MOST_BUCKETS, SEED = 8 << 20, 20_000, 17


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffle_shards(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of `docs` in a struct `row`, with size, law, shard and slot."""
    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    sums = docs.agg(F.sum(size_of(t)).alias("bytes"), F.count("*").alias("rows")).first()
    total, buckets = sums.rows, min(MOST_BUCKETS, max(1, -(-(sums.bytes or 0) // bucket_bytes)))
    bucket = F.pmod(F.xxhash64(F.lit(seed), i, t), F.lit(buckets)).cast("int").alias("bucket")

    # the first place of every bucket, from at most MOST_BUCKETS counts
    counts = docs.select(bucket).groupBy("bucket").agg(F.count("*").alias("n"))
    first = counts.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("first"))

    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    scattered = docs.select(bucket, F.xxhash64(F.lit(seed + 1), i, t).alias("key"), F.xxhash64(*plain).alias("tie"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    ordered = scattered.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "key", "tie")
    # a partition holds one bucket, so that the rows before a row in it are those before it in the bucket
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")
    numbered = ordered.select("bucket", "row", at)
    placed = numbered.join(F.broadcast(first), "bucket").select((F.col("first") + F.col("at")).alias("place"), "row", size_of(F.col("row").getField(text)).alias("size"))
    # shard s has places ceil(s * total / shards) up to the next shard's first
    shard = F.floor(F.col("place") * shards / F.lit(max(1, total))).cast("int")
    exact = F.when(F.col("place") * shards >= (shard + 1).cast("long") * total, shard + 1).when(F.col("place") * shards < shard.cast("long") * total, shard - 1).otherwise(shard)
    begin = F.floor((exact.cast("long") * total + (shards - 1)) / shards)
    return placed.select("row", "size", F.lit("rows").alias("law"), exact.alias("shard"), (F.col("place") - begin).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, folder: str, shards: int = 16, parts: int = 4) -> None:
    """Write each shard's rows in slot order as shard=N folders of up to `parts` files, each a run of slots."""
    run = F.pmod(F.col("slot"), F.lit(parts))
    sharded.withColumn("part", run).repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "slot").select("shard", "slot", "row.*").write.partitionBy("shard").parquet(folder)
