import numpy as np
import pyarrow as pa

from folio.llm import quality_knn as k
from tests.llm.conftest import prose

GOOD = [prose(i) for i in range(30)]
BAD = [" ".join(["word###"] * 30 + [prose(i, 5)]) for i in range(30)]


def test_votes_against_plain_cosines():
    model = k.fit([(t, 1) for t in GOOD[:20]] + [(t, 0) for t in BAD[:20]])
    rows = np.concatenate(list(k.all_features(pa.array(GOOD[20:] + BAD[20:]))))
    got = k.vote(rows, model)
    for row, score in zip(rows, got, strict=True):
        v = row @ model.basis
        cosines = sorted(((float(v @ m / np.linalg.norm(v)), float(y)) for m, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: k.NEIGHBOURS]
        weights = [np.exp(k.SHARPNESS * (c - 1)) for c, _ in cosines]
        assert abs(score - sum(w * y for w, (_, y) in zip(weights, cosines, strict=True)) / sum(weights)) < 1e-3
    assert (got[:10] > 0.5).all() and (got[10:] < 0.5).all()


def test_of_equal_cosines_the_first_drawn_count():
    """Copies of a labelled text tie; labels of the NEIGHBOURS first ones vote."""
    n = k.NEIGHBOURS
    model = k.fit([(GOOD[0], 1)] * n + [(GOOD[0], 0)] * (2 * n) + [(t, 0) for t in BAD])
    rows = np.concatenate(list(k.all_features(pa.array([GOOD[0]] * 3))))
    assert np.allclose(k.vote(rows, model), 1.0)
    model.labels = model.labels[::-1].copy()
    model.vectors = model.vectors[::-1].copy()
    assert np.allclose(k.vote(rows, model), 0.0)


def test_features_do_not_depend_on_neighbours():
    alone = np.concatenate([np.concatenate(list(k.all_features(pa.array([t])))) for t in GOOD[:5] + BAD[:5]])
    together = np.concatenate(list(k.all_features(pa.array(GOOD[:5] + BAD[:5]))))
    assert np.allclose(alone, together)


def test_odd_rows(odd, none, labels):
    rows = k.score(odd, labels, out="made").collect()
    assert len(rows) == odd.count() and all(0 <= r.made <= 1 for r in rows) and rows[0].score == 0.5
    assert k.score(none, labels).count() == 0
    assert {r.made for r in k.score(odd, labels.limit(0), out="made").collect()} == {0.5}
    assert {r.made for r in k.score(odd, labels.where("quality = 1"), out="made").collect()} == {1.0}


def test_held_out_labels_are_not_learned(odd, labels):
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted((str(r.doc_id), r.made) for r in k.score(odd, x, out="made").collect()) for x in (labels, wrong))
    assert a == b


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = k.score(docs, labels, out="made").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").join(labels, "doc_id")
    assert found.where("(made >= 0.5) = (quality = 1)").count() >= 0.97 * found.count()


def plain_features(text):
    """A text's terms by plain counting."""
    data = (text or "").encode()
    shapes = []
    for b in data:
        if not shapes or shapes[-1] != k.SHAPE_OF[b]:
            shapes.append(int(k.SHAPE_OF[b]))
    out = np.zeros(k.TERMS)
    for x in zip(shapes, shapes[1:], shapes[2:], strict=False):
        out[(x[0] * k.SHAPES + x[1]) * k.SHAPES + x[2]] += 1
    out[: k.SHAPES**3] = k.WEIGHTS[0] * np.sqrt(out[: k.SHAPES**3] / max(1, len(shapes)))
    words = data.split()
    n = max(1, len(words))
    slots = np.zeros(k.WORD_TERMS)
    for w in words:
        low = np.frombuffer(w.lower(), np.uint8)
        slots[int(k.span_hashes(low, np.array([0]), np.array([len(low)]))[0]) >> 54] += 1
    out[k.SHAPES**3 : k.SHAPES**3 + k.WORD_TERMS] = k.WEIGHTS[1] * np.sqrt(slots / n)
    windows = [tuple(words[i : i + k.WINDOW]) for i in range(len(words) - k.WINDOW + 1)]
    lines = [x for x in data.split(b"\n") if x]
    signs = [sum(a == b for a, b in zip(words[lag:], words, strict=False)) / n for lag in range(1, k.LAGS + 1)]
    signs += [1 - len(set(x)) / len(x) if x else 0 for x in (windows, lines)] + [min(1.0, 8 / n)]
    out[k.SHAPES**3 + k.WORD_TERMS :] = k.WEIGHTS[2] * np.sqrt(signs)
    return out


def test_fitted_scores_against_plain_counting_and_svd():
    """50 texts scored by a model of 30 others: counts, decomposition, cosines and votes by other means."""
    texts = GOOD[15:] + BAD[15:] + ["", "one", "A-1 b\nb\n\nA-1 b", "ünï çode " * 20, "x\n" * 40] + [prose(i) + "\n" + prose(i, 9) for i in range(100, 115)]
    rows = [(t, 1) for t in GOOD[:15]] + [(t, 0) for t in BAD[:15]]
    table = np.array([plain_features(t) for t, _ in rows])
    used = (table > 0).sum(axis=0) >= 2
    _, _, turned = np.linalg.svd(table[:, used], full_matrices=False)
    basis = turned[: k.RANK].T
    unit = lambda v: v / max(1e-9, np.linalg.norm(v))
    known = [unit(r[used] @ basis) for r in table]
    want = []
    for t in texts:
        v = unit(plain_features(t)[used] @ basis)
        near = sorted(((round(float(v @ m), k.PLACES), -i) for i, m in enumerate(known)), reverse=True)[: k.NEIGHBOURS]
        weights = [np.exp(k.SHARPNESS * (c - 1)) for c, _ in near]
        want.append(sum(w * rows[-i][1] for w, (_, i) in zip(weights, near, strict=True)) / sum(weights))
    got = k.predict(pa.array(texts), k.fit(rows)).to_pylist()
    assert len(texts) == 50 and np.allclose(got, want, atol=2e-3)
