"""All functions that run in Python: what Spark has no expression for. Each takes and gives whole Arrow batches."""

from __future__ import annotations

import itertools
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import BLANKS, SENTENCE_END, START_OPENERS, TAG

WINDOW = 1000


def _column(function: Callable, kind: pa.DataType, returns: str, inputs: int = 1) -> Callable[..., Column]:
    """A column function that applies `function` to each row's values; null if any of them is null."""
    if inputs == 1:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([None if x is None else function(x) for x in batch.to_pylist()], kind)

        one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return lambda a: _once(one, returns)(a)  # made at the call: there is no session when this is imported

    return _of_pairs(lambda a, b: map(function, a, b), kind, returns)


def _of_pairs(function: Callable, kind: pa.DataType, returns: str) -> Callable[..., Column]:
    """A column function of two, which gets the rows of a batch as two lists, without those in which one of them is null."""

    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            pairs = [None if x is None or y is None else (x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
            found = iter(function(*map(list, zip(*filter(None, pairs), strict=True))) if any(pairs) else ())
            yield pa.array([None if pair is None else next(found) for pair in pairs], kind)

    two.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return lambda a, b: _once(two, returns)(a, b)


def _once(function: Callable, returns: str) -> Callable[..., Column]:
    """A function over Arrow batches that counts as nondeterministic, so that the optimizer neither repeats it for each use
    of its result nor moves a filter on that below it with a copy of it."""
    return F.arrow_udf(function, returns).asNondeterministic()


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


class _Marks(dict):
    """For translation: combining marks to nothing, all other characters to themselves; each is asked for once."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.category(chr(code)) == "Mn" else code
        return self[code]


_MARKS = _Marks()


def fold(text: str) -> str:
    """Without combining marks."""
    return text if text.isascii() else unicodedata.normalize("NFD", text).translate(_MARKS)


def packed_share(text: str) -> float:
    """Size after compression as a share of the size before; low for repetitive text."""
    data = text.encode()
    return len(zlib.compress(data, 9)) / max(1, len(data))


def packed_shares(text: str) -> list[float]:
    """The same for every WINDOW characters."""
    return [packed_share(text[i : i + WINDOW]) for i in range(0, len(text), WINDOW)]


#: Comments and declarations, tags with their attributes, and text.
_MARKUP = regex.compile(r"""(?s)<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:"[^"]*"|'[^']*'|[^>"'])*)>|(?P<text>[^<]+|<)""")
_SPAN = regex.compile(r"(?i)(?:^|[\s/])(?:row|col)span\s*(?:=|$|[\s/])")


def table_rows(html: str, spans: bool = False) -> list[list[str]] | None:
    """Cells by row; None if a cell spans others, unless `spans` says that it counts as one; [] without a table.

    A cell's text runs to the next start of a cell or row, or to the end of a cell, row or table. A row opens where a tag
    says so, or with the first cell that closes.
    """
    rows: list[list[str]] = []
    cell: list[str] | None = None
    for m in _MARKUP.finditer(html):
        name = (m["name"] or "").lower()
        is_cell = name in ("td", "th")
        if m["text"] is not None or name == "br" and not m["end"]:
            if cell is not None:
                cell.append(unescape(m["text"]) if m["text"] else " ")
            continue
        if not (is_cell or name == "tr" or name == "table" and m["end"]):
            continue
        if cell is not None:
            rows = rows or [[]]
            rows[-1].append(" ".join("".join(cell).split()))
            cell = None
        if m["end"]:
            continue
        if is_cell:
            if not spans and _SPAN.search(m["more"]):
                return None
            cell = []
        else:
            rows.append([])
    if cell is not None:
        rows = rows or [[]]
        rows[-1].append(" ".join("".join(cell).split()))
    return [r for r in rows if r]


#: Cells of an alignment that are held at a time.
ALIGNED_CELLS = 1 << 22


def _edges(truth: np.ndarray, reading: np.ndarray) -> np.ndarray:
    """Costs of turning the whole truth into every beginning of the reading."""
    place = np.arange(len(reading) + 1)
    row = place.copy()
    for i, c in enumerate(truth, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (reading != c))
        # the cheapest way along the row: what comes from the left costs one a place
        row = np.minimum.accumulate(np.concatenate(([i], step)) - place) + place
    return row


def _paired(truth: np.ndarray, reading: np.ndarray) -> list[int]:
    """For every character of the truth the place that stands for it in a cheapest alignment; -1 where it is left out."""
    n, m = len(truth), len(reading)
    if not n or not m:
        return [-1] * n
    if n > 1 and (n + 1) * (m + 1) > ALIGNED_CELLS:
        half = n // 2  # Hirschberg: some cheapest alignment passes where both halves' costs add up to the least
        cut = int(np.argmin(_edges(truth[:half], reading) + _edges(truth[half:][::-1], reading[::-1])[::-1]))
        return _paired(truth[:half], reading[:cut]) + [x if x < 0 else x + cut for x in _paired(truth[half:], reading[cut:])]
    place = np.arange(m + 1)
    cost = np.empty((n + 1, m + 1), np.int32)
    cost[0] = place
    for i in range(1, n + 1):
        step = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (reading != truth[i - 1]))
        cost[i] = np.minimum.accumulate(np.concatenate(([i], step)) - place) + place
    out, i, j = [-1] * n, n, m
    while i:
        if j and cost[i, j] == cost[i - 1, j - 1] + (truth[i - 1] != reading[j - 1]):
            i, j = i - 1, j - 1
            out[i] = j
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _ends(truth: str, reading: str) -> tuple[int, int]:
    """Lengths of the equal beginnings and of the equal ends behind them."""
    n = min(len(truth), len(reading))
    a, b = _codes(truth), _codes(reading)
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    return head, int(np.argmin(np.append(a[len(a) - n + head :][::-1] == b[len(b) - n + head :][::-1], False)))


def _changed(truth: str, reading: str) -> list[tuple[str, str]] | None:
    """Characters that differ place by place, if texts of one length can't be had by fewer edits than these; else None.

    Edits of any kind bring in what the reading has and the truth lacks one by one, so it is sure where none of the
    characters put in is one of those that they took the place of.
    """
    if len(truth) != len(reading):
        return None
    found = [(x, y) for x, y in zip(truth, reading, strict=True) if x != y]
    return found if {x for x, _ in found}.isdisjoint(y for _, y in found) else None


def _within(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edits between two texts on ways that stay within a band along the diagonal; exact if it is no more than the band."""
    n, m, far = len(a), len(b), len(a) + len(b) + 1
    place = np.arange(2 * band + 1)
    near = np.concatenate((np.full(band, -1), b.astype(np.int64), np.full(max(0, n - m) + band + 1, -1)))
    row = np.where((place >= band) & (place - band <= m), place - band, far)
    for i, c in enumerate(a.astype(np.int64), 1):
        # at a place of the row the reading's place is i - band + place, whose letter is one before
        step = np.minimum(row + (near[i - 1 : i + 2 * band] != c), np.append(row[1:], far) + 1)
        at = place + (i - band)
        step[(at < 0) | (at > m)] = far
        if i <= band:
            step[band - i] = i
        row = np.minimum.accumulate(step - place) + place
    return int(row[m - n + band])


#: Half the width of the first band in which a distance is looked for; each next one is four times as wide.
FIRST_BAND = 8


def distance(truth: str, reading: str) -> int:
    """Edits between two texts. Its cost is the length where letters are changed in place, else the length times the distance."""
    if truth == reading:
        return 0
    if (changed := _changed(truth, reading)) is not None:
        return len(changed)
    head, tail = _ends(truth, reading)
    a, b = (_codes(x[head : len(x) - tail]) for x in (truth, reading))
    if not len(a) or not len(b):
        return max(len(a), len(b))
    band = max(FIRST_BAND, abs(len(a) - len(b)))
    while (found := _within(a, b, band)) > band:
        band *= 4
    return found


def aligned(truth: str, reading: str) -> list[tuple[str, str | None]]:
    """For every character of the truth what stands for it in a cheapest alignment; None where it is left out.

    Letters that are changed in place are told as such. Otherwise equal beginnings and ends are set aside; the rest is
    aligned row by row, and in halves where it is long.
    """
    if _changed(truth, reading) is not None:
        return list(zip(truth, reading, strict=True))
    head, tail = _ends(truth, reading)
    a, b = (x[head : len(x) - tail] for x in (truth, reading))
    middle = [(c, None if at < 0 else b[at]) for c, at in zip(a, _paired(_codes(a), _codes(b)), strict=True)]
    return [(c, c) for c in truth[:head]] + middle + [(c, c) for c in truth[len(truth) - tail :]]


#: Letters whose marks are scored.
ACCENTED = "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"


def accents(truth: str, reading: str) -> dict:
    """Accented letters of the truth, how many were read right, and what stood for the others."""
    total = 0 if truth.isascii() else sum(map(truth.count, ACCENTED))
    pairs = _changed(truth, reading)
    if pairs is None:
        pairs = aligned(truth, reading) if total else []
    wrong = [f"{a}→{'∅' if b is None else b}" for a, b in pairs if a != b and a in ACCENTED]
    return {"total": total, "right": total - len(wrong), "wrong": wrong}


#: Characters that are compared place by place at a time.
PIECE = 1 << 20


def _differing(truths: list[str], readings: list[str]) -> Iterator[list[int] | None]:
    """The places at which the texts of each pair differ; None where their lengths do. Whole pieces of pairs are compared at once."""
    lo = 0
    while lo < len(truths):
        hi, n = lo, 0
        while hi < len(truths) and (hi == lo or n + len(truths[hi]) <= PIECE):
            n += len(truths[hi])
            hi += 1
        same = [(a, b) for a, b in zip(truths[lo:hi], readings[lo:hi], strict=True) if len(a) == len(b)]
        ends = np.cumsum([0] + [len(a) for a, _ in same])
        at = np.flatnonzero(_codes("".join(a for a, _ in same)) != _codes("".join(b for _, b in same)))
        cuts = np.searchsorted(at, ends).tolist()
        places, k = at.tolist(), 0
        for a, b in zip(truths[lo:hi], readings[lo:hi], strict=True):
            if len(a) != len(b):
                yield None
                continue
            start = int(ends[k])
            yield [x - start for x in places[cuts[k] : cuts[k + 1]]]
            k += 1
        lo = hi


def _put_in(truth: str, reading: str, places: list[int]) -> bool:
    """Whether what stands at these places is a cheapest way from one to the other, as in `_changed`."""
    return len(places) < 2 or {truth[k] for k in places}.isdisjoint(reading[k] for k in places)


def distances(truths: list[str], readings: list[str]) -> Iterator[int]:
    """The distance of each pair."""
    for a, b, places in zip(truths, readings, _differing(truths, readings), strict=True):
        yield distance(a, b) if places is None or not _put_in(a, b, places) else len(places)


_ACCENTED = frozenset(ACCENTED)


def all_accents(truths: list[str], readings: list[str]) -> Iterator[dict]:
    """What `accents` tells of each pair."""
    for a, b, places in zip(truths, readings, _differing(truths, readings), strict=True):
        if places is None or not _put_in(a, b, places):
            yield accents(a, b)
            continue
        wrong = [f"{a[k]}→{b[k]}" for k in places if a[k] in ACCENTED]
        total = 0 if a.isascii() else sum(map(a.count, _ACCENTED.intersection(a)))
        yield {"total": total, "right": total - len(wrong), "wrong": wrong}


_DIFF = pa.struct([(k, pa.string()) for k in ("kind", "before", "a", "b", "after")])
#: Words that a difference takes at most to be one of words, and words that are shown around it.
FEW_WORDS, AROUND = 6, 6


class Windows:
    """Names of the windows of two lists of ids: equal windows of a length have equal names, wherever they stand.

    A window of twice a length is named by the names of its halves; any other length by two windows that overlap.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.n = len(a)
        self.names = [np.unique(np.concatenate((a, b)), return_inverse=True)[1].astype(np.int64)]

    def _level(self, k: int) -> np.ndarray:
        while len(self.names) <= k:
            half = 1 << len(self.names) - 1
            last = self.names[-1]
            both = last[: max(0, len(last) - half)] * (len(last) + 1) + last[half:]
            self.names.append(np.unique(both, return_inverse=True)[1].astype(np.int64))
        return self.names[k]

    def of(self, lo: int, hi: int, size: int) -> np.ndarray:
        """The names of all windows of a size that lie within places lo to hi of both lists end to end."""
        k = size.bit_length() - 1
        names, shift = self._level(k), size - (1 << k)
        first = names[lo : hi - size + 1]
        return first * (len(self.names[0]) + 1) + names[lo + shift : hi - size + 1 + shift]

    def longest(self, a1: int, a2: int, b1: int, b2: int) -> tuple[int, int, int]:
        """Places and size of the longest window that both ranges have; of several the first in a, then in b."""
        lo, hi, best = 1, min(a2 - a1, b2 - b1), (a1, b1, 0)
        size = hi and 1
        while lo <= hi:
            ours, theirs = self.of(a1, a2, size), self.of(self.n + b1, self.n + b2, size)
            hits = np.flatnonzero(np.isin(ours, theirs))
            if len(hits):
                at = int(hits[0])
                best = (a1 + at, b1 + int(np.argmax(theirs == ours[at])), size)
                lo = size + 1
                size = min(hi, 2 * size) if hi - size > size else (lo + hi) // 2
            else:
                hi = size - 1
                size = (lo + hi) // 2
        return best


def blocks_of(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Equal blocks of two lists of ids in order: the longest common one, then those of what is left before and behind it."""
    windows, found, todo = Windows(a, b), [], [(0, len(a), 0, len(b))]
    while todo:
        a1, a2, b1, b2 = todo.pop()
        i, j, size = windows.longest(a1, a2, b1, b2) if a1 < a2 and b1 < b2 else (0, 0, 0)
        if size:
            found.append((i, j, size))
            todo += [(a1, i, b1, j), (i + size, a2, j + size, b2)]
    merged: list[tuple[int, int, int]] = []
    for i, j, size in sorted(found):
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            i, j, size = merged[-1][0], merged[-1][1], merged.pop()[2] + size
        merged.append((i, j, size))
    return merged


def placed_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]] | None:
    """Equal blocks of two lists that stand at the same places, if no other alignment can have more that agrees; else None.

    It is so where the lists are of one length and the words of the second that differ aren't in the first at all.
    """
    if len(a) != len(b):
        return None
    apart = np.flatnonzero(a != b)
    if len(apart) and np.isin(b[apart], a).any():
        return None
    edges = np.concatenate(([-1], apart, [len(a)]))
    return [(int(i) + 1, int(i) + 1, int(j - i) - 1) for i, j in itertools.pairwise(edges) if j - i > 1]


def gaps_of(blocks: list[tuple[int, int, int]], n: int, m: int) -> list[tuple[int, int, int, int]]:
    """What lies between blocks: ranges of both lists, one of which may be empty."""
    out, i, j = [], 0, 0
    for x, y, size in [*blocks, (n, m, 0)]:
        if i < x or j < y:
            out.append((i, x, j, y))
        i, j = x + size, y + size
    return out


def _lists(column: pa.Array) -> tuple[list, np.ndarray]:
    """A column's words end to end, and where each row's begin (one more at the end)."""
    sizes = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
    return column.flatten(), np.concatenate(([0], np.cumsum(sizes)))


def differences(a: pa.Array, b: pa.Array) -> pa.Array:
    """Where the word lists of two columns differ, row by row, with the words around, and how many words agree; null if either is.

    Words that are changed where they stand are told as such, however often the words around them are repeated; all else
    goes by the longest block.
    """
    (left, at), (right, bt) = _lists(a), _lists(b)
    ids = pa.concat_arrays([left, right]).dictionary_encode().indices.fill_null(-1).to_numpy()
    words, others, codes = left.to_pylist(), right.to_pylist(), (ids[: len(left)], ids[len(left) :])
    rows = []
    for row in range(len(a)):
        if not (a.is_valid()[row].as_py() and b.is_valid()[row].as_py()):
            rows.append(None)
            continue
        x, y = at[row], bt[row]
        n, m = int(at[row + 1] - x), int(bt[row + 1] - y)
        left_ids, right_ids = codes[0][x : x + n], codes[1][y : y + m]
        blocks = placed_blocks(left_ids, right_ids)
        if blocks is None:
            blocks = blocks_of(left_ids, right_ids)
        text = lambda source, start, lo, hi: " ".join(w or "" for w in source[start + lo : start + hi])
        found = [
            {"kind": "word" if max(i2 - i1, j2 - j1) <= FEW_WORDS else "block", "before": text(words, x, max(0, i1 - AROUND), i1), "a": text(words, x, i1, i2), "b": text(others, y, j1, j2), "after": text(words, x, i2, min(n, i2 + AROUND))}
            for i1, i2, j1, j2 in gaps_of(blocks, n, m)
        ]
        rows.append({"agreed": sum(size for _, _, size in blocks), "found": found})
    return pa.array(rows, pa.struct([("agreed", pa.int32()), ("found", pa.list_(_DIFF))]))


def differences_of(a: Column, b: Column) -> Column:
    """struct<agreed, found> of two columns of word lists."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield differences(x, y)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return _once(run, "struct<agreed:int,found:array<struct<kind:string,before:string,a:string,b:string,after:string>>>")(a, b)


def strings_in(text: Column, strings: Broadcast) -> Column:
    """array<long>: the numbers of the strings (string, number) that a text holds, found in one walk over it.

    Equal numbers of different strings are told apart by nothing: numbers are hashes of the strings.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for string, number in strings.value:
            automaton.add_word(string, number)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            yield pa.array([sorted({n for _, n in automaton.iter(x)}) if x and len(automaton) else [] for x in batch.to_pylist()], pa.list_(pa.int64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return _once(run, "array<long>")(text)


_SKIPPED = frozenset(BLANKS + START_OPENERS)


def placed_words(texts: pa.Array, pattern: str, mask: bool = True) -> pa.Array:
    """Words of each text with their places, tags masked unless told not to, and whether each starts a sentence.

    Sums of lengths are linear here; as expressions they take a shuffle of all words, or a square of a text's words.
    """
    find, tag = regex.compile(pattern).finditer, regex.compile(TAG)
    sizes, start, end, words, first = [0], [], [], [], []
    for text in texts.to_pylist():
        shown = text or ""
        masked = tag.sub(lambda m: " " * len(m.group()), shown) if mask and "<" in shown else shown
        for m in find(masked):
            i = m.start() - 1
            while i >= 0 and shown[i] in _SKIPPED:
                i -= 1
            start.append(m.start())
            end.append(m.end())
            words.append(m.group())
            first.append(i < 0 or shown[i] in SENTENCE_END)
        sizes.append(len(words))
    found = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(words, pa.string()), pa.array(first, pa.bool_())], names=["start", "end", "word", "starts"])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), found)


def placed_words_of(text: Column, pattern: str, mask: bool = True) -> Column:
    """array<struct<start, end, word, starts>> of a text column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield placed_words(batch, pattern, mask)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return _once(run, "array<struct<start:int,end:int,word:string,starts:boolean>>")(text)


nfc_of = _column(nfc, pa.string(), "string")
fold_of = _column(fold, pa.string(), "string")
packed_share_of = _column(packed_share, pa.float64(), "double")
packed_shares_of = _column(packed_shares, pa.list_(pa.float64()), "array<double>")
table_rows_of = _column(table_rows, pa.list_(pa.list_(pa.string())), "array<array<string>>")
spanned_rows_of = _column(lambda html: table_rows(html, True), pa.list_(pa.list_(pa.string())), "array<array<string>>")
distance_of = _of_pairs(distances, pa.int32(), "int")
accents_of = _of_pairs(all_accents, pa.struct([("total", pa.int32()), ("right", pa.int32()), ("wrong", pa.list_(pa.string()))]), "struct<total:int,right:int,wrong:array<string>>")
