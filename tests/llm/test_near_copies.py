import itertools
import random

import pytest
from pyspark.sql import functions as F

from folio.llm import near_copies as nc
from folio.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Least id reachable over pairs at 0.8."""
    root, sets = list(range(len(rows))), [plain(t) for _, t in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        met = len(sets[i] & sets[j])
        if 5 * met >= 4 * (len(sets[i]) + len(sets[j]) - met):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), 1 << 60), doc_id)
    return [(str(d), least.get(find(k))) for k, (d, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def planted():
    """Originals with edited copies on both sides of 0.8, chains of edits, and a large group around one original."""
    rng = random.Random(5)
    edit = lambda words, n: [f"new{rng.random()}" if i in at else w for at in [set(rng.sample(range(len(words)), n))] for i, w in enumerate(words)]
    texts = []
    for k in range(30):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 300))]
        texts.append(words)
        for _ in range(4):
            texts.append(edit(words, min(len(words), rng.randint(0, 1 + len(words) // 30))))
        if k % 3 == 0:
            for _ in range(5):
                words = edit(words, 1)
                texts.append(words)
    base = [f"b{i}" for i in range(200)]
    texts += [edit(base, 3) for _ in range(60)]
    return list(enumerate(" ".join(t) for t in texts))


def test_planted_near_copies(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    got = [(str(r.doc_id), r.component_id) for r in nc.near_copies(docs).collect()]
    assert sorted(got) == sorted(brute(planted))
    kept = {r.doc_id for r in nc.keep_one(docs).collect()}
    assert kept == {c for _, c in brute(planted)} and len(kept) < len(planted) // 2


def test_the_stage_drops_looser_copies(spark, planted):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()} == {c for _, c in brute(planted)}


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(((str(r.doc_id), r.component_id) for r in nc.near_copies(odd).collect()), key=str) == sorted(brute(rows), key=str)
    assert nc.keep_one(odd).columns == odd.columns and nc.near_copies(none).count() == 0


def test_simhash_step(spark):
    """Where no MinHash key meets another, operator 4's links still do; fingerprints that agree without the sets link nothing."""
    words = [f"w{i}" for i in range(400)]
    far = ["x", "y", "z"] * 500
    texts = [" ".join(words), " ".join([*words[:-1], "v"]), " ".join(far + [f"p{i}" for i in range(40)]), " ".join(far + [f"q{i}" for i in range(40)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", nc.sketches(F.col("text")).alias("s"), simhash.fingerprints(F.col("text")).alias("simhash")).select("doc_id", "s.*", "simhash")
    values = rows.select("fp", "size", F.array("fp").alias("keys"), "b0", "b1", "b2", F.col("doc_id").alias("least"))
    fp = {r.doc_id: r.fp for r in rows.collect()}
    assert {(r.u, r.v) for r in nc.simhash_pairs(rows).collect()} == {(max(a, b), min(a, b)) for a, b in ((fp[0], fp[1]), (fp[2], fp[3]))}
    assert [(r.u, r.v) for r in nc.links(docs, values, rows).collect()] == [(max(fp[0], fp[1]), min(fp[0], fp[1]))]
    assert sorted((r.doc_id, r.component_id) for r in nc.near_copies(docs).collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_marks_take_one_worker_a_task(spark, odd, monkeypatch):
    """Sketches and fingerprints come from one function; two would have two Python workers in each task."""
    seen, kept = [], nc.checkpoint
    monkeypatch.setattr(nc, "checkpoint", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    nc.near_copies(odd)
    assert max(plan.count("ArrowEvalPython") for plan in seen) == 1
    got = odd.select(nc.marks(F.col("text")).alias("m")).select("m.*")
    want = odd.select(nc.sketches(F.col("text")).alias("s"), simhash.fingerprints(F.col("text")).alias("simhash")).select("s.*", "simhash")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
