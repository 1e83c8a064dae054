import functools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import language_id
from tests.llm.conftest import DEUTSCH, WORDS, prose


def test_odd_rows(odd, none):
    rows = language_id.identify(odd, out="found").collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    for i in (100, 101, 102, 103):
        assert (by_id[i].found.lang, by_id[i].found.score) == ("und", 0.0)
    assert all(r.found.lang == r.lang for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert all(0 <= r.found.score <= 1 for r in rows)
    assert by_id[105].found.lang == "en" and by_id[0].language == "z"
    assert language_id.identify(none).count() == 0
    replaced = language_id.identify(odd)  # a column of the result's name is replaced
    assert replaced.schema["language"].dataType.simpleString() == "struct<lang:string,score:double>"


def test_nothing_to_learn_from(spark, odd):
    blank = odd.withColumn("lang", odd.lang.substr(1, 0)).selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r.found.lang for r in language_id.identify(blank, out="found").collect()} == {"und"}


def test_held_out_rows_are_not_learned(spark):
    """Wrong labels on held-out rows change nothing."""
    rows = [(i, prose(i, words=DEUTSCH if i % 2 else WORDS), "de" if i % 2 else "en") for i in range(80)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    names = "doc_id long, text string, lang string"
    a, b = (sorted((r.doc_id, r.found.lang, r.found.score) for r in language_id.identify(spark.createDataFrame(x, names), out="found").collect()) for x in (rows, wrong))
    assert a == b


@functools.cache
def grams(text):
    """Sets of n-grams by plain slices."""
    t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    while "  " in t:
        t = t.replace("  ", " ")
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_equals_sets_of_ngrams(monkeypatch):
    texts = [("abc abd", "a"), ("xyz, xyy 12", "b"), ("Ünïcödé ßtraße", "a"), ("漢字かな交じり文 漢字", "c"), ("абв абг", "d"), ("a", "b")]
    for alphabet in (language_id.ALPHABET, 2):
        monkeypatch.setattr(language_id, "ALPHABET", alphabet)
        model = language_id.fit(texts)
        table = language_id.Grams()
        got = np.concatenate(list(language_id._kernels([table.of(t) for t, _ in texts], model)))
        rows = [t for x in model.languages for t, lang in texts if lang == x]
        for i, (a, _) in enumerate(texts):
            for j, b in enumerate(rows):
                both = len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
                assert abs(got[i, j] - both) < 1e-5
        assert not table.seen.any() and not table.flags.any()


def brute(rows, texts):
    """Languages and scores by set intersections and one ridge regression a language on Nystroem features."""
    languages = sorted({lang for _, lang in rows})
    landmarks = []
    for x in languages:
        own = list(dict.fromkeys(frozenset(grams(t)) for t, lang in rows if lang == x))
        landmarks += own[: language_id.LANDMARKS]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    size, basis = np.linalg.eigh(np.array([[kernel(a, b) for b in landmarks] for a in landmarks]))
    kept = size > 1e-6 * size[-1]
    feature = lambda t: np.append(np.array([kernel(grams(t), b) for b in landmarks]) @ (basis[:, kept] / np.sqrt(size[kept])), 1)
    x = np.array([feature(t) for t, _ in rows])
    out = {}
    for lang in languages:
        y = np.array([1.0 if own == lang else -1.0 for _, own in rows])
        w = np.array([1 / sum(own == other for _, other in rows) for _, own in rows])
        solved = np.linalg.solve((x.T * w) @ x + language_id.RIDGE * np.eye(x.shape[1]), (x.T * w) @ y)
        for t in texts:
            out.setdefault(t, []).append(feature(t) @ solved)
    return {t: (languages[int(np.argmax(v))], min(1, max(0, (max(v) + 1) / 2))) for t, v in out.items()}


def test_fitted_predictions_against_brute_force():
    rows = [(prose(i, 12, DEUTSCH if i % 2 else WORDS), "de" if i % 2 else "en") for i in range(60)] + [(prose(i, 9, "река свет дом утро птицы".split()), "ru") for i in range(9)]
    texts = [prose(i, 15, (WORDS, DEUTSCH, WORDS + DEUTSCH)[i % 3]) for i in range(100, 130)] + ["дом", "12 a", "漢"]
    want = brute(rows, texts)
    got = language_id.predictor(language_id.fit(rows))(pa.array(texts)).to_pylist()
    for t, r in zip(texts, got, strict=True):
        assert r["lang"] == want[t][0] and abs(r["score"] - want[t][1]) < 1e-3


def test_many_scripts():
    """Two invented languages in each of five scripts, of more letters than any table of classes would hold."""
    rng, rows = random.Random(3), {0: [], 1: []}
    for k, start in enumerate((0x61, 0x3B1, 0x430, 0x5D0, 0x905)):
        for half in (0, 1):
            letters = [chr(start + i) for i in range(22)]
            words = ["".join(rng.choices(letters, weights=[1 + (i * (3 + half)) % 7 for i in range(22)], k=rng.randint(2, 7))) for _ in range(150)]
            for i in range(60):
                rows[i % 2].append((" ".join(rng.choices(words, k=25)), f"{k}{half}"))
    got = language_id.predictor(language_id.fit(rows[0]))(pa.array([t for t, _ in rows[1]])).to_pylist()
    assert sum(r["lang"] == lang for r, (_, lang) in zip(got, rows[1], strict=True)) >= 0.99 * len(got)


def test_the_sample_is_bounded_over_all_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_ROWS", 60)
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 100)
    rows = [(i, f"text {i}", f"l{i % 7}") for i in range(700)] + [(1000 + i, "long " * (30 + i), "x") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample(docs, "doc_id", "text", "lang")
    by = Counter(lang for _, lang in got)
    assert [by[f"l{i}"] for i in range(7)] == [7] * 7 and by["x"] == 1 and got == language_id.sample(docs.repartition(5), "doc_id", "text", "lang")
    assert min(len(t) for t, lang in got if lang == "x") == min(len(t) for i, t, lang in rows if lang == "x" and zlib.crc32(str(i).encode()) % 3 != 1)
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    learned = Counter(lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    assert {lang for _, lang in language_id.sample(docs, "doc_id", "text", "lang")} == set(sorted(learned, key=lambda x: (-learned[x], x))[:3])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs, out="found").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    assert found.where("lang = found.lang").count() >= 0.98 * found.count()


@pytest.mark.parametrize("ids", [[1], [7], [None], [1, 7], list(range(3000))])
def test_rows_that_share_ids_are_learned_from(spark, ids):
    """A language isn't lost whose rows have one id, none, or two."""
    rows = [(ids[k % len(ids)], prose(k), "en") for k in range(1500)] + [(10_000 + k, prose(k, words=DEUTSCH), "de") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = Counter(lang for _, lang in language_id.sample(docs, "doc_id", "text", "lang"))
    assert learned["en"] == min(language_id.PER_LANGUAGE, len({(i, t) for i, t, lang in rows if lang == "en" and zlib.crc32(str(i).encode()) % 3 != 1})) or ids == [None] and learned["en"] == language_id.PER_LANGUAGE
    got = {(r.lang, r.language.lang) for r in language_id.identify(docs).collect()}
    assert got == {("en", "en"), ("de", "de")}
