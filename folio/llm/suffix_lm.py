"""Language model scoring by a probabilistic suffix tree over words.

The root's distribution is that of single tokens, one added to each count, over all tokens of the training documents.
A longer context becomes a state if its next-token distribution diverges from that of its longest retained suffix by
enough (a likelihood-ratio test and a least gain a token). A state's probabilities are drawn towards its suffix's;
what a state doesn't list goes to its suffix, scaled so that all probabilities sum to one. A text is scored by the
longest state at each token.

Counts cover all training documents, and contexts have any length up to DEPTH words. Single-token counts stay in a
distributed table: tokens with at least 1/COMMON of all occurrences (at most COMMON of them) are broadcast, the rest are
joined. Contexts are tried from short to long and only those with at least 1/CONTEXTS of all tokens can be states, with each
further word a DEEPER part of that (1/LISTED at least), as longer contexts are rarer and fewer; next tokens with at least 1/NEXT are counted
apart and 1/LISTED listed. So the tree, which every task holds, has a bound that the corpus doesn't move. What stands
behind rarer contexts is scored by the table of single tokens, which grows with the corpus.

Defined results: tokens are lower-cased (A-Z) words and one end token for each document; a null text is an empty one
and has the end token alone; a text of any length is scored whole, a batch's texts a megabyte at a time; an empty table
gives no rows; without training tokens every score is 0; rows that repeat an id and a text each
get their own equal row; other columns may be there, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import checkpoint, held_out, runs

#: Bounds as shares of all tokens: broadcast tokens, states of a depth, next tokens, listed pairs of a depth.
COMMON, CONTEXTS, NEXT, LISTED = 1_000_000, 40_000, 100_000, 1_000_000
#: By how much the share that a context needs falls with each word of it after the first.
DEEPER = 4
#: Longest context, tokens that any state of one word lists (a quarter with each further word), strength of the pull to the suffix, and the tests of divergence.
DEPTH, DENSE, PULL, LEAST_GAIN, LEAST_RATIO = 5, 32, 20.0, 0.01, 20.0
#: Distinct keys held by a task before they are sent on.
HELD = 400_000
END = b""


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of training documents and of all, summed within a task."""
    sums = [Counter(), Counter()]

    def out() -> pa.RecordBatch:
        words = list(sums[0].keys() | sums[1].keys())
        n = [sums[0][w] for w in words]
        batch = pa.record_batch([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array([x + sums[1][w] for x, w in zip(n, words, strict=True)], pa.int64())], names=["word", "n", "n_all"])
        for s in sums:
            s.clear()
        return batch

    for batch in batches:
        for text, held in zip(batch.column(0).fill_null("").cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[bool(held)].update(tokens(text))
            if len(sums[0]) + len(sums[1]) > HELD:
                yield out()
    yield out()


@dataclass
class State:
    """States of one depth, by index: rows of listed next tokens and the scale of the rest."""

    scale: np.ndarray
    kept: np.ndarray
    codes: np.ndarray
    logs: np.ndarray
    suffix: np.ndarray


@dataclass
class Tree:
    """Bounded parts of the model. Token ids are ranks by training count; `next_size` of them may be listed."""

    n: int
    v: int
    words: list[bytes]
    counts: np.ndarray
    next_size: int
    context_size: int
    keys: list[np.ndarray]
    states: list[State]

    def ids(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def root(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + 1.0) - math.log10(self.n + self.v + 1)


def contexts(ids: np.ndarray, first: np.ndarray, keys: list[np.ndarray], context_size: int) -> list[np.ndarray]:
    """For every depth, each position's context as an index into that depth's keys, or -1.

    A depth's key is the shorter context's index and the token before it; the start of a document counts as a token.
    """
    begin = context_size
    out = []
    place = np.arange(len(ids))
    start = np.repeat(first[:-1], np.diff(first))
    known = np.where(ids < context_size, ids, -1)
    shorter = np.zeros(len(ids), np.int64)
    for depth, table in enumerate(keys, 1):
        back = place - depth
        token = np.where(back >= start, known[np.maximum(back, 0)], np.where(back == start - 1, begin, -1))
        code = shorter * (context_size + 1) + token
        at = np.minimum(np.searchsorted(table, code), max(0, len(table) - 1))
        found = (table[at] == code) & (token >= 0) & (shorter >= 0) if len(table) else np.zeros(len(ids), bool)
        shorter = np.where(found, at, -1)
        out.append(shorter)
    return out


def _chunked(batch: pa.RecordBatch, get, most: int = 1 << 20):
    """Ids (-1: not common), tokens and first places of documents lo..hi of a batch, for about `most` bytes at a time."""
    texts = batch.column(0).fill_null("").cast(pa.binary()).to_pylist()
    lo = 0
    while lo < len(texts):
        hi, size, found, first = lo, 0, [], [0]
        while hi < len(texts) and (hi == lo or size < most):
            found += tokens(texts[hi])
            first.append(len(found))
            size += len(texts[hi])
            hi += 1
        yield lo, hi, np.fromiter([get(t, -1) for t in found], np.int64, len(found)), found, np.array(first)
        lo = hi


def _to_ids(words):
    """A mapper that gives each document's tokens as 32-bit ids, -1 for those that aren't among the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {w: i for i, w in enumerate(words.value)}.get
        for batch in batches:
            for lo, hi, ids, _, first in _chunked(batch, get):
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((first * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype(np.int32).tobytes())])
                yield pa.record_batch([packed], names=["ids"])

    return run


def _id_chunks(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and first places of documents, for about `most` bytes of ids at a time."""
    packed = batch.column(0).cast(pa.large_binary())
    offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)
    for lo, hi in runs(offsets, most):
        yield data[offsets[lo] : offsets[hi]].view(np.int32).astype(np.int64), (offsets[lo : hi + 1] - offsets[lo]) // 4


def _count_next(tree, keys_so_far: int):
    """A mapper that counts (context of the deepest table, next token) codes over training documents' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes = np.concatenate([c for c, _ in held])
            sums = np.concatenate([n for _, n in held])
            unique, back = np.unique(codes, return_inverse=True)
            return unique, np.bincount(back, weights=sums, minlength=len(unique)).astype(np.int64)

        for batch in batches:
            for ids, first in _id_chunks(batch):
                deepest = contexts(ids, first, t.keys, t.context_size)[keys_so_far - 1]
                good = deepest >= 0
                # tokens that can't be listed share one code, so that the context's total is complete
                following = np.where(ids >= 0, ids, t.next_size)
                codes, n = np.unique(deepest[good] * (t.next_size + 1) + following[good], return_counts=True)
                held.append((codes, n))
                size += len(codes)
                if size > HELD * 5:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > HELD * 2:
                        yield pa.record_batch([pa.array(held[0][0]), pa.array(held[0][1])], names=["code", "n"])
                        held.clear()
                        size = 0
        if held:
            codes, n = merged()
            yield pa.record_batch([pa.array(codes), pa.array(n)], names=["code", "n"])

    return run


def _suffixes(depth: int, table: np.ndarray, width: int, states: list[State]) -> np.ndarray:
    """For each context of a depth its longest retained suffix as (depth - 1) * 2**32 + index; -1 is the root."""
    shorter = table // width
    if depth == 1:
        return np.full(len(table), -1, np.int64)
    above = states[-1]
    return np.where(above.kept[shorter], ((depth - 2) << 32) | shorter, above.suffix[shorter])


def log_prob(tree: Tree, suffix: np.ndarray, token: np.ndarray) -> np.ndarray:
    """log10 probability of common tokens in the states named by `suffix` codes."""
    out = np.zeros(len(token))
    open_ = np.arange(len(token))
    state = suffix.copy()
    while len(open_):
        at_root = state[open_] < 0
        r = open_[at_root]
        out[r] += tree.root(tree.counts[token[r]])
        open_ = open_[~at_root]
        for depth in np.unique(state[open_] >> 32):
            own = open_[(state[open_] >> 32) == depth]
            s, index = tree.states[depth], state[own] & 0xFFFFFFFF
            code = index * (tree.next_size + 1) + token[own]
            at = np.minimum(np.searchsorted(s.codes, code), max(0, len(s.codes) - 1))
            hit = (s.codes[at] == code) & (token[own] < tree.next_size) if len(s.codes) else np.zeros(len(own), bool)
            out[own[hit]] += s.logs[at[hit]]
            out[own] += np.where(hit, 0, s.scale[index])
            state[own] = np.where(hit, -2, s.suffix[index])
        open_ = open_[state[open_] != -2]
    return out


def dense_of(tree: Tree, depth: int) -> int:
    """The commonest tokens that every state of a depth lists."""
    return min(DENSE >> 2 * (depth - 1), tree.next_size)


def _states(tree: Tree, depth: int, codes: np.ndarray, counts: np.ndarray, totals: np.ndarray, least: float) -> State:
    """Test, list and smooth the contexts of one depth from their next-token counts."""
    size, width = len(tree.keys[depth - 1]), tree.next_size + 1
    suffix = _suffixes(depth, tree.keys[depth - 1], tree.context_size + 1, tree.states)
    dense = dense_of(tree, depth)
    listed = counts >= least
    code = np.unique(np.concatenate([codes[listed & (codes % width < tree.next_size)], (np.arange(size)[:, None] * width + np.arange(dense)).ravel()]))
    at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
    n = np.where(codes[at] == code, counts[at], 0) if len(codes) else np.zeros(len(code), np.int64)
    index, token = code // width, code % width
    below = 10 ** log_prob(tree, suffix[index], token)
    chance = (n + PULL * below) / (totals[index] + PULL)
    own_mass = np.bincount(index, weights=chance, minlength=size)
    below_mass = np.bincount(index, weights=below, minlength=size)
    scale = np.maximum(1e-12, 1 - own_mass) / np.maximum(1e-12, 1 - below_mass)
    gain = np.bincount(index, weights=chance * np.log(np.maximum(chance, 1e-300) / below), minlength=size) + np.maximum(0, 1 - own_mass) * np.log(scale)
    kept = (gain >= LEAST_GAIN) & (2 * totals * gain >= LEAST_RATIO) & (totals >= least)
    use = kept[index]
    return State(np.log10(scale), kept, code[use], np.log10(chance[use]), suffix)


def train(docs: DataFrame, counts: DataFrame) -> Tree:
    """Grow the tree over the training documents (columns text, held), given the checkpointed token counts."""
    spark = docs.sparkSession
    sums = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.sum("n_all").alias("a")).first()
    n, v, a = sums.n or 0, sums.v or 0, sums.a or 0
    common = counts.where(F.col("n_all") * COMMON >= a).toArrow()
    words, trained = common.column("word").to_pylist(), common.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-trained[i], words[i]))
    trained = trained[order]
    words = [words[i] for i in order]
    tree = Tree(n, v, words, trained.astype(np.float64), int((trained * NEXT >= max(n, 1)).sum()), int((trained * CONTEXTS >= max(n, 1)).sum()), [], [])
    # texts are cut into tokens once for all depths
    learned = None
    if n:
        learned = checkpoint(docs.where(~F.col("held")).select("text").mapInArrow(_to_ids(spark.sparkContext.broadcast(words[: tree.next_size])), "ids binary"))
    keys = np.arange(tree.context_size + 1, dtype=np.int64)
    for depth in range(1, DEPTH + 1):
        if not n or not len(keys):
            break
        tree.keys.append(keys)
        sent = spark.sparkContext.broadcast(Tree(n, v, [], trained[:0], tree.next_size, tree.context_size, tree.keys, []))
        width = tree.next_size + 1
        pairs = checkpoint(learned.mapInArrow(_count_next(sent, depth), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
        totals = np.zeros(len(keys))
        got = pairs.groupBy(F.floor(F.col("code") / width).cast("long").alias("i")).agg(F.sum("n").alias("n")).toArrow()
        totals[got.column("i").to_numpy()] = got.column("n").to_numpy()
        least = n / LISTED
        few = pairs.where(((F.col("n") >= least) & (F.col("code") % width < tree.next_size)) | (F.col("code") % width < dense_of(tree, depth))).orderBy("code").toArrow()
        codes, number = few.column("code").to_numpy(), few.column("n").to_numpy()
        tree.states.append(_states(tree, depth, codes, number, totals, least))
        index, token = codes // width, codes % width
        longer = (number * CONTEXTS * DEEPER**depth >= n) & (token < tree.context_size)
        # the next depth's contexts put one more token before these: for depth 1 the pair (a, b) gives b preceded by a
        keys = np.sort(_prepend(depth, tree, index[longer], token[longer]))
        sent.unpersist()
    return tree


def _prepend(depth: int, tree: Tree, index: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Keys of depth + 1 for contexts followed by a token: that token, preceded by the context."""
    width = tree.context_size + 1
    # unfold each context into its tokens, nearest first
    chain = []
    at = index
    for d in range(depth, 0, -1):
        code = tree.keys[d - 1][at]
        chain.append(code % width)
        at = code // width
    path = [token, *chain[::-1]]  # nearest first: the token, then the context from its nearest
    shorter = np.zeros(len(token), np.int64)
    good = np.ones(len(token), bool)
    for d in range(depth):
        code = shorter * width + path[d]
        table = tree.keys[d]
        slot = np.minimum(np.searchsorted(table, code), max(0, len(table) - 1))
        good &= table[slot] == code
        shorter = slot
    return (shorter * width + path[depth])[good]


def _score(tree):
    """A mapper that gives one row a document and one for each of its tokens that isn't common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tree = tree.value
        get = t.ids().get
        log_root = t.root(np.zeros(1))[0]
        row = 0
        for batch in batches:
            doc_ids, kind = batch.column(1).to_pylist(), batch.column(1).type
            for lo, hi, ids, found, first in _chunked(batch, get):
                common = ids >= 0
                base, score, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
                base[common] = t.root(t.counts[ids[common]])
                base[~common] = log_root  # log10 of count + 1 is added by the join
                known[common] = t.counts[ids[common]] > 0
                state = np.full(len(ids), -1, np.int64)
                for depth, at in enumerate(contexts(ids, first, t.keys, t.context_size)):
                    use = at >= 0
                    use[use] = t.states[depth].kept[at[use]]
                    state[use] = depth << 32 | at[use]
                score[common] = log_prob(t, state[common], ids[common])
                score[~common] = base[~common]
                rest, state_rest = np.flatnonzero(~common), state[~common]
                while len(rest):
                    up = state_rest >= 0
                    rest, state_rest = rest[up], state_rest[up]
                    for depth in np.unique(state_rest >> 32):
                        own = (state_rest >> 32) == depth
                        s, index = t.states[depth], state_rest[own] & 0xFFFFFFFF
                        score[rest[own]] += s.scale[index]
                        state_rest[own] = s.suffix[index]
                texts = batch.column(0)
                marks = [xxhash.xxh64_intdigest(texts[i].as_py() or "") - (1 << 63) for i in range(lo, hi)]
                sums = [np.add.reduceat(x, first[:-1]) for x in (base, score, known)]
                # rows of documents meet no word, and go wherever: equal texts to different tasks
                words = [b" %d %d" % (m, row + i) for i, m in enumerate(marks)]
                row += len(marks)
                rows = [words, doc_ids[lo:hi], marks, np.ones(hi - lo, np.int64), np.diff(first), *sums]
                rare = np.flatnonzero(~common)
                doc = np.searchsorted(first, rare, "right") - 1
                tally = Counter(zip(doc.tolist(), [found[i] for i in rare.tolist()], strict=True))
                yield _rows(rows, kind)
                if tally:
                    d = [k for k, _ in tally]
                    zero = np.zeros(len(d))
                    yield _rows([[w for _, w in tally], [doc_ids[lo + k] for k in d], [marks[k] for k in d], np.zeros(len(d), np.int64), np.fromiter(tally.values(), np.int64, len(d)), zero, zero, zero.astype(np.int64)], kind)

    return run


#: The second is the id's own type.
_KINDS = [pa.binary(), None, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
_NAMES = ["word", "doc_id", "mark", "is_doc", "number", "base", "score", "known"]


def _rows(columns: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k or kind) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`"), modulus, remainder).alias("held"))
    counted = rows.select("text", "held").mapInArrow(_count_words, "word binary, n long, n_all long")
    counts = checkpoint(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")))
    tree = train(rows, counts)
    found = rows.select("text", "doc_id").mapInArrow(_score(spark.sparkContext.broadcast(tree)), f"word binary, doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long, is_doc long, number long, base double, score double, known long")
    rare = counts.where("n > 0").select("word", F.col("n").alias("count"))
    joined = found.join(rare, "word", "left")
    is_rare = F.col("is_doc") == 0
    add = F.when(is_rare, F.col("number") * F.log10(F.coalesce("count", F.lit(0)) + 1.0)).otherwise(0.0)
    summed = joined.groupBy("doc_id", "mark").agg(
        F.sum("is_doc").alias("copies"),
        F.sum(F.col("is_doc") * F.col("number")).alias("n_tokens"),
        F.sum(F.col("known") + F.when(is_rare & F.col("count").isNotNull(), F.col("number")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + add).alias("base_score"),
        F.sum(F.col("score") + add).alias("score"),
    )
    each = F.col("copies")
    return summed.select(
        "doc_id",
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
        (F.col("n_tokens") / each).cast("long").alias("n_tokens"),
        (F.col("n_known") / each).cast("long").alias("n_known"),
        F.lit(tree.n).cast("long").alias("train_tokens"),
        (F.col("base_score") / each).alias("base_score"),
        (F.col("score") / each).alias("score"),
        F.explode(F.sequence(F.lit(1), each.cast("int"))).alias("copy"),
    ).drop("copy")
