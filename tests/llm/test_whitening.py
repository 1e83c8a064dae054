import math
from collections import Counter

import numpy as np
import pytest

from folio.llm import queries, whitening


def brute(rows):
    """(vec_id, component) -> n, deviation, whitened, explained; rows: (vec_id, vector)."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(x) for _, x in good)
    if not lengths:
        return {}
    length = max(lengths, key=lambda k: (lengths[k], k))
    good = [(i, x) for i, x in good if len(x) == length]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = [k for k in range(min(16, length)) if values[0] > 0 and values[k] > 1e-12 * values[0]]
    out = []
    for i, x in good:
        w = (np.array([c - s / n for c, s in zip(x, sums, strict=True)]) @ vectors[:, keep]) / np.sqrt(values[keep])
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        out += [(i, k + 1, n, deviation, w[k], values[k] / values.sum()) for k in keep]
    return out


def check(got, wanted):
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    assert sorted(map(key, got)) == sorted(map(key, wanted))
    left, right = {}, {}
    for side, rows in ((left, got), (right, wanted)):
        for r in rows:
            side[key(r)] = r
    for component in {k[1] for k in left}:
        keys = sorted(k for k in left if k[1] == component)
        a, b = np.array([left[k][4] for k in keys]), np.array([right[k][4] for k in keys])
        sign = np.sign(a @ b)
        assert np.allclose(a, sign * b, atol=1e-7)
        assert all(abs(left[k][5] / right[k][5] - 1) < 1e-9 for k in keys)


def rows_of(made):
    out = made.select("vec_id", "component.*").collect()
    assert len({r.identity_error for r in out}) <= 1 and all(r.identity_error < 1e-9 for r in out)
    return [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in out]


def test_planted_spectrum(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((400, 40)) * np.linspace(5, 0.5, 40) @ np.linalg.qr(rng.standard_normal((40, 40)))[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(i, rows[7][1]) for i in range(400, 700)] + [(3, rows[3][1])]  # copies count once in the fit
    rows += [(900, None), (901, []), (902, [1.0] * 39 + [None]), (903, [math.nan] * 40), (904, [math.inf] + [0.0] * 39), (905, [1.0] * 12), (None, rows[5][1])]
    docs = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, x int, row string").repartition(7)
    check(rows_of(whitening.whiten(docs)), brute(rows))


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_query(spark, scale):
    made = queries.op11_whitening(spark, f"/root/testdata/{scale}")
    assert dict(made.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").collect()]
    check([tuple(r)[:6] for r in made.collect()], brute(rows))


def test_little(spark):
    kind = "vec_id long, embedding array<float>"
    few = [(1, [0.0, 1.0, 0.0]), (2, [0.5, 1.0, 0.0]), (3, [0.25, -3.0, 0.0]), (4, [0.25, -3.0, 0.0])]
    check(rows_of(whitening.whiten(spark.createDataFrame(few, kind))), brute(few))
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(5, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).select("vec_id", "component.*").collect() == []


def test_large_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, -2.0]), (4, [5.0, 7.0])]
    made = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("vec_id", "component.*").collect()}
    x = [[max(-(1 << 53), min(1 << 53, math.floor(64 * c))) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert made == {i: sum((4 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True)}


def test_lanczos_restarts_and_breakdowns():
    rng = np.random.default_rng(4)
    for values in (np.concatenate((np.linspace(9, 2, 20), np.linspace(1, 0, 380))), np.concatenate((np.ones(30) * 5, np.zeros(270))), np.concatenate(([7, 7, 3], np.zeros(97)))):
        turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        matrix = turn * values @ turn.T
        passes = []

        def product(block):
            passes.append(block.shape[1])  # noqa: B023
            return matrix @ block  # noqa: B023

        got, vectors = whitening.lanczos(product, len(values), 6, beyond=2, most_blocks=4)
        assert np.allclose(got, np.sort(values)[::-1][:6], atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-11)
        assert np.linalg.norm(matrix @ vectors - vectors * got) < 1e-10
        assert len(passes) < 200
