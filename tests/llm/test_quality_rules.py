import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from folio.llm import quality_rules as q
from folio.llm.common import unit_hash


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    hit = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), sum("A" <= c <= "Z" for c in text), sum(c in "!?" for c in text)]


def test_counts_against_brute_force():
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "B!? ", "É", "\n", "# ", "|", "\t", "\x0b", " ", "a b c d e f g h ", "same line\n"], k=rng.randint(0, 60))) for _ in range(200)]
    for text, got in zip(texts, q.stats(pa.array(texts)).to_pylist(), strict=True):
        assert list(got.values()) == plain(text), repr(text)
    assert list(q.stats(pa.array([None], pa.string())).to_pylist()[0].values()) == [0] * 7
    assert len(q.stats(pa.array([], pa.string()))) == 0


def test_long_text():
    text = ("one two three four five six seven eight nine\n" * 5000) + "x" * 100_000
    got = q.stats(pa.array([text])).to_pylist()[0]
    assert (got["n_words"], got["n_dup_lines"], got["n_repeat_words"]) == (45001, 4999, 45000)


def test_binomial_bound():
    for n, k, p in ((10, 0, 0.1), (50, 3, 0.1), (200, 1, 0.02)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(q.binomial_tail(k, n, p) - exact) < 1e-12
    assert q.passes(0, 1000, 0.01, 0.001) and not q.passes(0, 100, 0.01, 0.001)
    assert not q.passes(11, 1000, 0.01, 0.001) and not q.passes(0, 0, 0.01, 0.001)


def test_bound_holds_for_random_labels():
    """Drawn at a rate above the risk, a cutoff passes in at most the share of draws that delta allows."""
    rng = random.Random(7)
    passed = sum(q.passes(sum(rng.random() < 0.011 for _ in range(800)), 800, 0.01, 0.05) for _ in range(400))
    assert passed <= 0.05 * 400 + 10


def test_ladder_and_climb():
    assert q.ladder({0: 900, 5: 90, 9: 10})[0] == 9 and q.ladder({0: 985, 5: 5, 9: 10}) == [9] * 8 + [5, 0]
    assert q.climb([0] * len(q.LADDER), 5000) == len(q.LADDER)
    assert q.climb([0, 10, 200, 0, 0, 0, 0, 0, 0, 0], 5000) == 2  # testing ends at the first that fails
    assert q.climb([0] * len(q.LADDER), 150) == 0


def test_the_grid_is_read_alike_on_both_sides(spark):
    """A statistic in the cutoff's step isn't over it."""
    values = [0.0, 1e-5, 1e-4, 0.02, 0.5, 1.0, 99.0, 1e6]
    got = [r.s for r in spark.createDataFrame([(x,) for x in values], "x double").select(q.step(F.col("x")).alias("s")).collect()]
    assert got == [grid(x) for x in values] and got[0] == 0 and got[-1] == q.STEPS


def grid(x):
    return 0 if x < 10.0**q.LOWEST else min(q.STEPS, math.floor((math.log10(x) - q.LOWEST) * q.A_DECADE) + 1)


def brute(docs, labels, first):
    """Verdicts by plain loops: docs by id, labels of 1, and ids of the first half."""
    steps, kept, part = {}, {}, {}
    for i, text in docs.items():
        n, chars, symbols, lines, repeats, upper, marks = plain(text or "")
        w = max(n, 1)
        steps[i] = [grid(x) for x in (symbols / w, lines / w, repeats / w, upper / max(chars, 1), marks / w, chars / w)]
        part[i] = sum(n >= x for x in q.STRATA)
        kept[i] = n >= 20 and 100 * repeats <= 30 * n
    cutoffs = {}
    for p in range(len(q.STRATA) + 1):
        good = [i for i in labels if i in docs and kept[i] and part[i] == p]
        one, two = [i for i in good if i in first], [i for i in good if i not in first]
        for share in q.LADDER:
            at = [min(s for s in range(q.STEPS + 1) if sum(steps[i][r] > s for i in one) <= share * len(one)) for r in range(6)]
            gone = sum(any(steps[i][r] > at[r] for r in range(6)) for i in two)
            if not two or gone > q.RISK * len(two) or q.binomial_tail(gone, len(two), q.RISK) > q.DELTA / 3:
                break
            cutoffs[p] = at
    return cutoffs, {i: k and not (part[i] in cutoffs and any(x > y for x, y in zip(steps[i], cutoffs[part[i]], strict=True))) for i, k in kept.items()}


def test_odd_rows(odd, none, labels):
    rows = q.judge(odd, labels).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    for i in (100, 101, 102):
        assert by_id[i].counts.n_words == 0 and by_id[i].base_failed and not by_id[i].kept
    assert by_id[105].kept or by_id[105].base_failed
    assert q.judge(none, labels).count() == 0
    assert all(r.kept != r.base_failed for r in q.judge(odd, labels.limit(0)).collect())


def test_rejections_on_real_rows(spark):
    """Cutoffs are chosen, bad rows go beyond those that the base rules reject, and all verdicts are those of plain loops."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = q.judge(docs, labels)
    labelled = found.join(labels, "doc_id")
    good = labelled.where("quality = 1 AND NOT base_failed")
    assert good.where("NOT kept").count() <= q.RISK * good.count()
    bad = labelled.where("quality = 0")
    assert bad.where("NOT kept").count() > 0.85 * bad.count() > 1.5 * bad.where("base_failed").count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {r.doc_id for r in docs.where(unit_hash(9, F.col("doc_id").cast("string")) < 0.5).collect()}
    cutoffs, kept = brute(texts, [r.doc_id for r in labels.where("quality = 1").collect()], first)
    assert cutoffs and {r.doc_id: r.kept for r in found.collect()} == kept
