import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from folio.llm import suffix_lm as s


def words(text):
    import re

    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w] + [""]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    follow = {w: rng.choices("a b c d e f g h É Ünit".split(), k=2) for w in "a b c d e f g h É Ünit".split()}
    rows = []
    for i in range(300):
        w = [rng.choice(list(follow))]
        for _ in range(rng.randint(0, 60)):
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.9 else f"rare{rng.randint(0, 200)}")
            if w[-1] not in follow:
                w.append("A")
            w[-1] = w[-1] if w[-1] in follow else "a"
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "a b a b"), (502, "a b a b"), (502, "other"), (None, "a b")]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, word int, held int")


@pytest.fixture(scope="module", params=[1_000_000, 20])
def scored(docs, request):
    """With all tokens broadcast, and with most of them joined."""
    old, trained = s.COMMON, {}
    s.COMMON = request.param
    grow = s.train
    try:
        s.train = lambda *a: trained.setdefault("tree", grow(*a))
        rows = s.score(docs).collect()
    finally:
        s.COMMON, s.train = old, grow
    return rows, trained["tree"]


def counts(docs):
    out = Counter()
    for r in docs.collect():
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            out.update(words(r.text))
    return out


def test_base_scores(docs, scored):
    rows, _ = scored
    c = counts(docs)
    n, v = sum(c.values()), len(c)
    want = []
    for r in docs.collect():
        w = words(r.text)
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2
        want.append((str(r.doc_id), held, len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(want)


def test_probabilities_of_each_state_sum_to_one(docs, scored):
    rows, tree = scored
    c = counts(docs)
    n, v = sum(c.values()), len(c)
    rest = 1 - (10 ** tree.root(tree.counts)).sum()  # of the tokens that aren't broadcast, and of the unknown
    assert n == tree.n and v == tree.v
    for depth, state in enumerate(tree.states):
        for i in np.flatnonzero(state.kept)[:20]:
            listed = 10 ** s.log_prob(tree, np.full(len(tree.words), depth << 32 | i), np.arange(len(tree.words)))
            scale, at = 1.0, int(depth << 32 | i)
            while at >= 0:
                own = tree.states[at >> 32]
                scale, at = scale * 10 ** own.scale[at & 0xFFFFFFFF], int(own.suffix[at & 0xFFFFFFFF])
            assert abs(listed.sum() + rest * scale - 1) < 1e-6


def test_scores_against_a_plain_walk(docs, scored):
    """The same tree walked token by token."""
    rows, tree = scored
    c = counts(docs)
    ids = tree.ids()

    def prob(history, token):
        for depth in range(min(len(history), len(tree.keys)), 0, -1):
            at = 0
            for d in range(depth):
                code = at * (tree.context_size + 1) + history[-1 - d]
                slot = np.searchsorted(tree.keys[d], code)
                if history[-1 - d] < 0 or slot >= len(tree.keys[d]) or tree.keys[d][slot] != code:
                    break
                at = int(slot)
            else:
                state = tree.states[depth - 1]
                if state.kept[at]:
                    return walk(depth - 1, at, token)
        return math.log10((c[token] + 1) / (tree.n + tree.v + 1))

    def walk(depth, at, token):
        state = tree.states[depth]
        i = ids.get(token.encode(), -1)
        code = at * (tree.next_size + 1) + i
        slot = np.searchsorted(state.codes, code)
        if 0 <= i < tree.next_size and slot < len(state.codes) and state.codes[slot] == code:
            return state.logs[slot]
        up = int(state.suffix[at])
        return state.scale[at] + (walk(up >> 32, up & 0xFFFFFFFF, token) if up >= 0 else math.log10((c[token] + 1) / (tree.n + tree.v + 1)))

    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(round(r.score, 5))
    for r in [r for r in docs.collect() if r.doc_id is not None][:60]:
        history, total = [tree.context_size], 0.0
        for token in words(r.text):
            total += prob(history, token)
            i = ids.get(token.encode(), -1)
            history.append(i if i < tree.context_size else -1)
        assert any(abs(total - x) < 1e-4 for x in got[r.doc_id])


def test_model_beats_the_base_on_held_out_texts(scored):
    rows, tree = scored
    held = [r for r in rows if r.held_out]
    assert sum(state.kept.sum() for state in tree.states) > 5
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_and_untrained(spark):
    names = "doc_id long, text string"
    assert s.score(spark.createDataFrame([], names)).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = s.score(spark.createDataFrame([(alone, "x y")], names)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == r.base_score == 0.0


def test_ids_of_any_kind(spark):
    """Ids that aren't numbers stay as they are, and so does which of them are held out; equal texts keep their own rows."""
    rows = [(f"{i:03}", "a b a b c") for i in range(40)] + [(None, "a b a b c"), ("x", "a b a b c")]
    got = s.score(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(r.doc_id.encode()) % 7 == 2) and r.n_tokens == 6 for r in got)
