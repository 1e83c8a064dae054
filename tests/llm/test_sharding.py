import zlib
from collections import Counter

from pyspark.sql import functions as F

from folio.llm import sharding


def check(rows, n, shards=16):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == n and all(0 <= s < shards for s in counts)
    assert max([counts[s] for s in range(shards)]) - min([counts[s] for s in range(shards)]) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_odd_rows(odd, none):
    rows = sharding.shuffle_shards(odd, bucket_bytes=4000).collect()
    check(rows, odd.count())
    assert Counter((r.row.doc_id, r.row.text) for r in rows) == Counter((r.doc_id, r.text) for r in odd.collect())
    assert all(r.size == len((r.row.text or "").encode()) + 1 for r in rows)
    assert sharding.shuffle_shards(none).count() == 0


def test_few_rows_and_many_buckets(spark):
    docs = spark.range(37).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for bucket_bytes in (1, 10, 1 << 20):
        check(sharding.shuffle_shards(docs, bucket_bytes=bucket_bytes).collect(), 37)
    check(sharding.shuffle_shards(docs.limit(3)).collect(), 3)


def test_order_is_shuffled_and_seeded(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    orders = [[r.row.doc_id for r in sorted(sharding.shuffle_shards(docs, seed=s).collect(), key=lambda r: (r.shard, r.slot))] for s in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2]
    assert sum(abs(a - i) for i, a in enumerate(orders[0])) / 500 > 100


def brute(rows, buckets, shards=16):
    """Shard and slot of rows (bucket, key, id), bucket by bucket in order of their keys."""
    order = [i for b in range(buckets) for *_, i in sorted(r for r in rows if r[0] == b)]
    bounds = [-(-s * len(order) // shards) for s in range(shards + 1)]
    return {i: (s, at - bounds[s]) for at, i in enumerate(order) for s in range(shards) if bounds[s] <= at < bounds[s + 1]}


def test_places_against_brute_force_for_any_split_of_the_input(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("text"))
    size = sum(len(r.text) + 1 for r in docs.collect())
    for buckets in (1, 7, 40):
        of = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "text")
        rows = [(r.b, r.k, r.doc_id) for r in docs.select("doc_id", F.pmod(of(3), F.lit(buckets)).alias("b"), of(4).alias("k")).collect()]
        want = brute(rows, buckets)
        for parts in (1, 9):
            got = sharding.shuffle_shards(docs.repartition(parts), seed=3, bucket_bytes=-(-size // buckets)).collect()
            assert {r.row.doc_id: (r.shard, r.slot) for r in got} == want


def test_texts_cross_the_shuffle_once(spark, odd):
    plan = sharding.shuffle_shards(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionById") + plan.count("RepartitionByExpression") == 1 and "collect_list" not in plan


def test_written_shards(odd, tmp_path, spark):
    sharding.write_shards(sharding.shuffle_shards(odd.select("doc_id", "text")), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and set(back.columns) == {"shard", "slot", "doc_id", "text"}


def test_query_digests(spark):
    from folio.llm.queries import op3_sharding

    rows = op3_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
