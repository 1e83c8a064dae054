"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each tree's leaves hold, for a pair of neighbouring symbols, its merge rank and place; the root is the
leftmost pair of lowest rank. A merge updates three leaves and their ancestors. Words of up to WIDE symbols
are merged side by side, one tree to a row of an array; longer ones get a tree of their own.

Defined results: a null text is an empty one and gives no ids and an empty decoded text; a symbol that the
vocabulary lacks is left out; a text of any length is encoded whole, a word of any length by a tree of its own; an empty
table gives no rows; equal rows give equal results; other columns are kept, and one that is named as the result is replaced.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import arrow_column

#: Most symbols of a word that is merged in the array of trees.
WIDE = 32
#: Words remembered by a Python worker before the older half goes.
REMEMBERED = 60_000
#: Characters that are cut into words at a time, or one text.
PART = 1 << 19
_NONE = np.int64((1 << 62) - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """Reads a tokenizers JSON file of the kind word_bpe_49k: NFC, lower case, a split pattern, bytes, word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or (split["type"], level["type"]) != ("Split", "ByteLevel") or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: not a tokenizer of the kind that is supported")
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        # \s of the pattern is Unicode's White_Space, whatever the regular expression library takes it for
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.specials = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        strings = {i: s for s, i in (vocab | added).items()}
        self.strings = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        chars = byte_symbols()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in chars], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        codes = np.array([a << 20 | b for a, b, _ in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks, self.made = codes[order], order.astype(np.int64), np.array([c for *_, c in pairs], np.int64)
        self.rank_of = dict(zip(codes.tolist(), range(len(codes)), strict=True))
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE where they can't be merged."""
        code = left << 20 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """One segment tree for one word of any length."""
        n = len(symbols)
        width = 1 << max(0, (n - 1).bit_length())
        none, get = int(_NONE), self.rank_of.get
        symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            j = after[i]
            r = get(symbols[i] << 20 | symbols[j]) if j < n else None
            return none if r is None else r * width + i

        for i in range(n):
            tree[width + i] = leaf(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] != none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            symbols[i], after[i] = int(self.made[rank]), after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
            symbols[j] = -1
        return [s for s in symbols if s >= 0]

    def merge_many(self, start: np.ndarray) -> np.ndarray:
        """A segment tree for each row of symbols (-1: none), all stepped together until no root has a pair."""
        rows_, width = start.shape
        symbols = np.full((rows_, width + 1), -1, np.int64)
        symbols[:, :-1] = start
        ranks = self._rank(symbols[:, :-1], symbols[:, 1:])
        place = np.arange(width)
        levels = [np.where(ranks == _NONE, _NONE, ranks * width + place)]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
        after = np.broadcast_to(place + 1, (rows_, width)).copy()
        before = np.broadcast_to(place - 1, (rows_, width)).copy()
        rows = np.arange(rows_)

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            levels[0][r, i] = value
            for low, high in zip(levels, levels[1:], strict=False):
                i = i >> 1
                high[r, i] = np.minimum(low[r, 2 * i], low[r, 2 * i + 1])

        while True:
            root = levels[-1][:, 0]
            rows = rows[root[rows] != _NONE]
            if not len(rows):
                return symbols
            rank, i = np.divmod(root[rows], width)
            j = after[rows, i]
            k = after[rows, j]
            symbols[rows, i], symbols[rows, j], after[rows, i] = self.made[rank], -1, k
            inner = k < width
            before[rows[inner], k[inner]] = i[inner]
            put(rows, j, np.full(len(rows), _NONE))
            r = self._rank(symbols[rows, i], np.where(inner, symbols[rows, k], -1))
            put(rows, i, np.where(r == _NONE, _NONE, r * width + i))
            h = before[rows, i]
            led = h >= 0
            rows_h, h = rows[led], h[led]
            r = self._rank(symbols[rows_h, h], symbols[rows_h, i[led]])
            put(rows_h, h, np.where(r == _NONE, _NONE, r * width + h))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, whose last symbol carries the word end."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum(size)
        symbols = self.inner[data]
        symbols[end - 1] = self.final[data[end - 1]]
        out: list = [None] * len(words)
        odd = np.zeros(len(words), bool)
        if (symbols < 0).any():  # symbols that the vocabulary lacks: those words are merged without them
            odd[np.unique(np.searchsorted(end, np.flatnonzero(symbols < 0), "right"))] = True
        for at in np.flatnonzero(odd | (size > WIDE)):
            own = symbols[end[at] - size[at] : end[at]]
            out[at] = self.merge_long(own[own >= 0].tolist())
        width = 4
        while width <= WIDE:
            group = np.flatnonzero(~odd & (size <= width) & ((size > width // 2) | (width == 4)))
            for lo in range(0, len(group), 4096):
                part = group[lo : lo + 4096]
                place = np.arange(width)
                inside = place < size[part, None]
                at = np.where(inside, (end - size)[part, None] + place, 0)
                merged = self.merge_many(np.where(inside, symbols[at], -1))
                cut = np.cumsum((merged >= 0).sum(axis=1)).tolist()
                flat = merged[merged >= 0].tolist()
                first = 0
                for word, last in zip(part.tolist(), cut, strict=True):
                    out[word] = flat[first:last]
                    first = last
            width *= 2
        return out

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens of a text; an added token is told by its place in `added`."""
        if self.specials is None or not any(s in text for s in self.added):
            return self.pattern.findall(self.normalise(text))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self.pattern.findall(self.normalise(text[at : m.start()]))
            out.append("\0" + m.group())  # a word never begins with NUL and goes on with other kinds of character unmatched
            at = m.end()
        return out + self.pattern.findall(self.normalise(text[at:]))

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-cased by character, so never as a word's last sigma
        return text.lower()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The tokens' strings, spaced: what a tokenizer without a decoder gives."""
        strings = self.strings
        return b" ".join([strings[i] for i in ids])

    def learn(self, words: set[str]) -> None:
        """Remember the ids and decoded text of words."""
        new = [w for w in words if w not in self.young]
        if len(self.young) + len(new) > REMEMBERED:
            self.old, self.young = self.young, {}
            new = list(words)
        if not new:
            return
        kept = {w: self.old[w] for w in new if w in self.old}
        self.young |= kept
        new = [w for w in new if w not in kept]
        plain = [w for w in new if not self._is_added(w)]
        for w in set(new) - set(plain):
            i = self.added[w[1:]]
            self.young[w] = (i.to_bytes(4, "little"), self.decode([i]))
        for w, ids in zip(plain, self.encode_words(plain), strict=True):
            self.young[w] = (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids))

    def _is_added(self, word: str) -> bool:
        return word[0] == "\0" and word[1:] in self.added

    def run(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian 32-bit integers and its decoded text in UTF-8."""
        out: list[tuple[bytes, bytes]] = []
        lo = 0
        while lo < len(texts):
            hi, size, found, words = lo, 0, [], set()
            while hi < len(texts) and (hi == lo or size < PART):
                found.append(p := self.pieces(texts[hi]))
                words.update(p)
                size += len(texts[hi])
                hi += 1
            self.learn(words)
            get = self.young.__getitem__
            for p in found:
                known = [get(w) for w in p]
                ids = b"".join([k[0] for k in known])
                out.append((ids, b" ".join([k[1] for k in known if k[0]])))
            lo = hi
        return out


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of this Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def _batch(texts: pa.Array, path: str) -> pa.Array:
    done = tokenizer(path).run([x or "" for x in texts.to_pylist()])
    sizes = pa.array([len(ids) // 4 for ids, _ in done], pa.int64())
    return pa.StructArray.from_arrays([sizes, pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.binary()).cast(pa.string())], names=["n_tokens", "packed", "decoded"])


def bpe(text: Column, path: str) -> Column:
    """struct<n_tokens, packed, decoded>: the ids packed as little-endian unsigned 32-bit integers, and their text."""
    return arrow_column(lambda: lambda texts: _batch(texts, path), "n_tokens long, packed binary, decoded string")(text)


def unpack(packed: bytes) -> list[int]:
    """The ids of a packed value."""
    return np.frombuffer(packed, "<u4").tolist()


def encode_decode(docs: DataFrame, path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """Add a struct `out` with the number of ids, the packed ids and the decoded text of every whole text."""
    return docs.withColumn(out, bpe(F.col(f"`{text}`"), path))
