import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import partenum as pe
from tests.llm.test_near_copies import planted  # noqa: F401


def plain(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """doc_id, set size and the least id reachable over pairs at 0.8."""
    root, all_ = list(range(len(rows))), [plain(t) for _, t in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        met = len(all_[i] & all_[j])
        if met and 100 * met >= 80 * (len(all_[i]) + len(all_[j]) - met):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), 1 << 60), doc_id)
    return sorted((str(d), len(all_[k]), str(least.get(find(k)))) for k, (d, _) in enumerate(rows))


def got(docs):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in pe.jaccard_classes(docs).collect())


def test_planted_near_copies(spark, planted):  # noqa: F811
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    assert got(docs) == brute(planted)


def test_shared_passages_and_small_sets(spark):
    """Texts that share a long passage without being copies, with copies among them, and texts of 1 to 12 words."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        own = [f"o{rng.random()}" for _ in range(rng.randint(5, 60))]
        at = rng.randint(0, len(own))
        words = own[:at] + passage + own[at:]
        texts += [words, [*words[:-1], "other"]]
    for n in range(1, 13):
        words = [f"s{n}-{i}" for i in range(n)]
        texts += [words, words + ["more"], words[1:], words]
    rows = list(enumerate(" ".join(t) for t in texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got(odd) == brute(rows)
    assert pe.jaccard_classes(none).count() == 0
    assert pe.jaccard_classes(none).columns == ["doc_id", "n_shingles", "component_id"]


def test_any_split_of_the_work(spark, planted, monkeypatch):  # noqa: F811
    """Tasks that hold few signatures, and many tasks of the second step, change nothing."""
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(5)
    known, number = pe.Bands(), 50_000
    few = {(r.u, r.v) for r in pe.candidates(docs.select("text"), number).collect()}
    monkeypatch.setattr(pe, "FEW", 3)
    monkeypatch.setattr(pe, "HELD", 100)
    monkeypatch.setattr(pe, "BUCKET", 500)
    many = {(r.u, r.v) for r in pe.candidates(docs.select("text"), number).collect()}

    def classes(pairs):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for u, v in pairs:
            root[find(u)] = find(v)
        return {x: find(x) for x in root}

    one, two = classes(few), classes(many)
    assert one.keys() == two.keys() and len(set(zip(map(one.get, one), map(two.get, one), strict=True))) == len(set(one.values()))
    assert known.number(np.array([10])) > 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 1 << 30), st.data())
def test_every_pair_that_agrees_enough_shares_a_signature(size, seed, data):
    rng = np.random.default_rng(seed)
    gone = data.draw(st.integers(0, size // 5))
    both = rng.integers(0, 1 << 63, size + size // 5 + 1, np.uint64)
    a, shared = both[:size], both[gone:size]
    most = (5 * len(shared)) // 4 - size  # what the other set may have of its own
    if most < 0:
        return
    b = np.concatenate((shared, both[size : size + data.draw(st.integers(0, most))]))
    met = len(shared)
    assert 5 * met >= 4 * (len(a) + len(b) - met)
    if set(a.tolist()) == set(b.tolist()):
        return
    value, owner = pe.signatures(np.concatenate((np.sort(a), np.sort(b))), np.array([len(a), len(b)]), pe.Bands())
    assert np.intersect1d(value[owner == 0], value[owner == 1]).size


def test_bands():
    found = pe.bands(1000)
    assert [(b.first, b.last) for b in found[:5]] == [(1, 1), (2, 2), (3, 3), (4, 5), (6, 7)]
    for b, after in itertools.pairwise(found):
        assert after.first == b.last + 1 and 5 * b.last // 4 <= after.last and b.without >= 0
