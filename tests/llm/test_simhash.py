import itertools
import random

import numpy as np
import xxhash

from folio.llm import simhash
from folio.llm.graph import components


def plain(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(values):
    """Least index reachable over links of two bits."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprints(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    texts = [" ".join(rng.choices(["Aa", "b", "ß", "c!"], k=k)) for k in (0, 1, 2, 3, 4, 50, 9000)] + [" \t ", "A  b\nc\x0bd"]
    for text in texts:
        assert simhash.fingerprint(text.encode()) == plain(text)
    # Spark's own hash of a shingle is the same
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_masks_cover_all_pairs_within_the_radius():
    kept = simhash.masks()
    assert len(kept) == 7
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m & (1 << i | 1 << j) for m in kept)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(9)
    values = set()
    for _ in range(40):  # clusters, chains and strangers
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(at)
            for _ in range(rng.randint(0, 3)):
                at ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    groups = brute_groups(values)
    for i, j in itertools.combinations(range(len(values)), 2):
        assert (groups[i] == groups[j]) == (found.get(signed[i], signed[i]) == found.get(signed[j], signed[j]))


def test_large_groups_of_distinct_fingerprints(spark):
    """Many values in one bucket: links stay in proportion, and one component comes out."""
    values = [(x,) for x in range(1024)]
    links = simhash.links(spark.createDataFrame(values, "fp long"))
    assert links.count() < 1024 * 7 * 29
    assert len({r.root for r in components(links).collect()}) == 1


def test_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 20)  # so that some groups count as hot
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    texts = odd.select("doc_id", "text").collect()
    values = [plain(r.text or "") for r in texts]
    groups = brute_groups(values)
    least = {}
    for g, r in zip(groups, texts, strict=True):
        if r.doc_id is not None:
            least[g] = min(least.get(g, 1 << 60), r.doc_id)
    want = sorted((str(r.doc_id), v - (1 << 64) if v >> 63 else v, least.get(g)) for r, v, g in zip(texts, values, groups, strict=True))
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in rows) == want
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert 4 in ids and 104 not in ids and 100 in ids and 101 not in ids
    assert np.all(np.diff(ids) >= 0)
