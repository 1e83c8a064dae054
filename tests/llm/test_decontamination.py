import random

import numpy as np

from folio.llm import decontamination as d
from tests.llm.conftest import prose


def brute(text, items):
    words = d.words_of(text)
    hit, found = [False] * len(words), set()
    for item, item_text in items:
        own = d.words_of(item_text)
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1) if own else ():
            if tuple(words[i : i + size]) in windows:
                found.add(item)
                hit[i : i + size] = [True] * size
    return len(words), sum(hit), sorted(found)


def told(x):
    return x["n_words"], sum(s["end"] - s["start"] for s in x["spans"]), x["items"]


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = lambda letters, sizes, n: [" ".join(rng.choices(letters.split(), k=rng.choice(sizes))) for _ in range(n)]
    for letters in ("ab cé", "ab cé D x y z w v u t s r q p o n m l k j i"):
        items = list(enumerate(texts(letters, [0, 1, 2, 9, 10, 11, 30], 25)))
        docs = [*texts(letters + ", q!", range(60), 200), *(f"{items[i][1]}!{items[i + 1][1]}?? {items[i][1]}" for i in range(20)), None, ""]
        found = d.decontaminate(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        for r in found.collect():
            assert told(r.decon.asDict(True)) == brute(r.text, [(str(i), t) for i, t in items])


def test_the_places_of_a_bounded_map_miss_nothing(spark, monkeypatch):
    """A map that is full lets everything through; the join decides alike."""
    items = spark.createDataFrame([(i, prose(i, 40)) for i in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(i + 40, 90)) for i in range(30)], "doc_id long, text string")
    before = sorted(map(str, d.decontaminate(docs, items).collect()))
    monkeypatch.setattr(d, "LEAST_BITS", 7)
    monkeypatch.setattr(d, "MOST_BITS", 7)
    assert sorted(map(str, d.decontaminate(docs, items).collect())) == before and "Row(start" in str(before)


def test_winnowing_guarantee():
    """Of any window of k-grams the least is kept."""
    grams = np.random.default_rng(2).integers(0, 50, 500).astype(np.uint64)
    kept = d.winnow(grams, 6)
    for i in range(len(grams) - 5):
        assert kept[i : i + 6][grams[i : i + 6] == grams[i : i + 6].min()].all()


def test_words_as_the_contract_has_them():
    assert d.words_of("A-b_c É1\x7fz") == [b"a", b"b", b"c", "É1".encode(), b"z"]


def test_odd_rows_by_either_join(spark, odd, monkeypatch):
    items = spark.createDataFrame([(1, prose(3, 25)), (2, prose(8, 12)), (3, "two words"), (None, "x"), (4, None), (5, prose(3, 25)), (6, " , "), (7, "river"), (1, "stone")], "item_id long, text string")
    one = d.decontaminate(odd, items, out="found")
    assert one.columns == [*odd.columns, "found"]
    one = one.collect()
    monkeypatch.setattr(d, "BROADCAST_BYTES", -1)
    many = d.decontaminate(odd, items, out="found").collect()
    key = lambda r: (str(r.doc_id), str(r.text)[:40], str(r.found))
    assert sorted(map(key, one)) == sorted(map(key, many))
    pairs = [(str(r.item_id), r.text) for r in items.dropna().collect()]
    for r in many:
        assert told(r.found.asDict(True)) == brute(r.text, pairs)
    assert [r.found["items"] for r in many if r.doc_id == 3] and any(r.found["items"] for r in many)


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(odd, items, out="f").where("size(f.items) > 0").count() == 0
    assert d.decontaminate(none, items, out="f").count() == 0
