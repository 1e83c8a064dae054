"""Quality rules with risk-controlled thresholds.

Base rules reject texts of under 20 words and texts in which over 30 % of the words stand in repeated eight-word
windows. Further rules compare statistics with cutoffs chosen on labelled holdouts, within each stratum (a class of text
length). Labelled documents of label 1 are dealt into two halves by a seeded hash. The first half gives each rule a
ladder of cutoffs, at which a share of LADDER of its documents would be over. The second half tests the rungs, all
rules together, from the mildest on: the exact (Clopper-Pearson) upper bound on the share of good documents that the
rules reject must be at most RISK. Testing ends at the first rung that fails (fixed sequence), so rungs need no
correction among themselves; strata share the error DELTA (Bonferroni). The strictest rung that passed is used; where
none does, only the base rules reject.

Statistics are compared on a logarithmic grid, and labelled rows are counted by its steps before anything is gathered,
so that the driver gets strata x rules x STEPS counts at most whatever the input, and the same ones in any order of rows.

Defined results: a null text has no words; without labels only the base rules reject; an id with several labels counts
as its lowest; a statistic in the step of its cutoff is not over it; repeated rows get equal verdicts; an empty table
gives no rows; a text of any length is counted whole; the results have columns of their own, whatever the table's are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import WORD_BYTES, arrow_column, byte_set, checkpoint, chunks, gram_hashes, per_doc, span_hashes, unit_hash, word_bounds

WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Share of good documents that may be falsely rejected, by all rules together, and the chance of breaking that.
RISK, DELTA = 0.02, 0.05
#: Shares of the first half's good documents that are over a rule's cutoff at each rung, mildest first.
LADDER = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.004, 0.006, 0.008, 0.012, 0.02)
#: Upper ends of the strata's word counts; one more stratum is open.
STRATA = (120, 400)
#: Steps of the grid: A_DECADE to a tenfold value, from 10^LOWEST on; step 0 holds what is below.
STEPS, A_DECADE, LOWEST = 480, 80, -4
SYMBOLS = byte_set(*b"#*$%&|<>")
CAPITALS, MARKS = byte_set((0x41, 0x5A)), byte_set(*b"!?")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long"

def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that are found twice or more."""
    seen: dict[tuple, int] = {}
    windows = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    last, total = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + WINDOW - max(last, i)
            last = i + WINDOW
    return total


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def stats(texts: pa.Array) -> pa.Array:
    """Counts of every text. Hashes tell the documents without repeats; the others are counted exactly."""
    names = [x.split()[0] for x in STATS.split(", ")]
    columns: list[list[np.ndarray]] = [[] for _ in names]
    for c in chunks(texts):
        starts, ends, first = word_bounds(c.data, c.offsets, WORD_BYTES)
        inside = WORD_BYTES[c.data] & ((c.data & 0xC0) != 0x80)
        hashes = span_hashes(c.data, starts, ends)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        windows = gram_hashes(hashes, WINDOW)
        of = doc[: len(windows)]
        whole = of == doc[WINDOW - 1 :] if len(windows) else np.zeros(0, bool)
        repeats = _with_repeats(windows[whole], of[whole], len(first) - 1)
        cuts = np.union1d(c.offsets, np.flatnonzero(c.data == 10) + 1)
        line_from, line_to = cuts[:-1], cuts[1:].copy()
        line_to -= c.data[line_to - 1] == 10 if len(line_to) else 0
        keep = line_to > line_from
        line_from, line_to = line_from[keep], line_to[keep]
        line_doc = np.searchsorted(c.offsets, line_from, "right") - 1
        lines = _with_repeats(span_hashes(c.data, line_from, line_to), line_doc, len(first) - 1)
        n_lines, n_repeats = np.zeros(len(first) - 1, np.int64), np.zeros(len(first) - 1, np.int64)
        for d in np.flatnonzero(repeats | lines):
            text = c.data[c.offsets[d] : c.offsets[d + 1]].tobytes()
            n_lines[d] = repeated_lines(text) if lines[d] else 0
            n_repeats[d] = repeated_words(text.split()) if repeats[d] else 0
        for column, values in zip(columns, (np.diff(first), per_doc(inside, c.offsets), per_doc(SYMBOLS[c.data], c.offsets), n_lines, n_repeats, per_doc(CAPITALS[c.data], c.offsets), per_doc(MARKS[c.data], c.offsets)), strict=True):
            column.append(values)
    return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in columns], names=names)


def _with_repeats(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which documents hold equal hashes."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    out = np.zeros(n, bool)
    out[d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])]] = True
    return out


def statistics(counts: Column) -> dict[str, Column]:
    """The rules' statistics from a struct of counts."""
    words = F.greatest(counts["n_words"], F.lit(1))
    return {
        "symbols_a_word": counts["n_symbols"] / words,
        "dup_lines_a_word": counts["n_dup_lines"] / words,
        "repeat_share": counts["n_repeat_words"] / words,
        "capital_share": counts["n_upper"] / F.greatest(counts["word_chars"], F.lit(1)),
        "marks_a_word": counts["n_marks"] / words,
        "word_length": counts["word_chars"] / words,
    }


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])


def stratum(counts: Column) -> Column:
    out = F.lit(len(STRATA))
    for i in reversed(range(len(STRATA))):
        out = F.when(counts["n_words"] < STRATA[i], i).otherwise(out)
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """Chance of at most k of n at rate p."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def passes(rejected: int, good: int, risk: float, delta: float) -> bool:
    """Whether the exact upper bound on the rate of false rejection, at confidence 1 - delta, is at most `risk`."""
    if not good or rejected > risk * good:
        return False  # the bound lies above the observed share
    return binomial_tail(rejected, good, risk) <= delta


def step(value: Column) -> Column:
    """The grid's step of a statistic."""
    return F.when(value < 10.0**LOWEST, 0).otherwise(F.least(F.floor((F.log10(value) - LOWEST) * A_DECADE) + 1, F.lit(STEPS))).cast("int")


def ladder(counts: dict[int, int]) -> list[int]:
    """For each rung the least step beyond which at most its share of the counted documents lies."""
    total, out = sum(counts.values()), []
    for share in LADDER:
        over, at = 0, STEPS
        while at and over + counts.get(at, 0) <= share * total:
            over += counts.get(at, 0)
            at -= 1
        out.append(at)
    return out


def climb(rejected: list[int], good: int) -> int:
    """Rungs that pass, from the mildest on, given how many of the second half's good documents each rejects."""
    for rung, n in enumerate(rejected):
        if not passes(n, good, RISK, DELTA / (len(STRATA) + 1)):
            return rung
    return len(rejected)


def thresholds(measured: DataFrame, labels: DataFrame, seed: int = 9) -> dict[int, dict[str, int]]:
    """Cutoffs by stratum and rule from rows (doc_id, counts) and labels; what the base rules reject doesn't count."""
    good = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    counts = F.col("counts")
    first = unit_hash(seed, F.col("doc_id").cast("string")) < 0.5
    steps = {rule: step(value).alias(rule) for rule, value in statistics(counts).items()}
    rows = checkpoint(measured.where(F.col("doc_id").isNotNull() & ~base_failed(counts)).join(good, "doc_id").select(first.alias("first"), stratum(counts).alias("part"), *steps.values()))
    each = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("step")) for rule in steps)))
    found: dict[tuple[int, str], dict[int, int]] = {}
    for r in rows.where("first").select("part", each.alias("x")).groupBy("part", "x.rule", "x.step").count().collect():
        found.setdefault((r.part, r.rule), {})[r.step] = r["count"]
    rungs = {key: ladder(counted) for key, counted in found.items()}
    out = {}
    for part in sorted({part for part, _ in rungs}):
        over = [F.count_if(_over({rule: rungs[part, rule][i] for rule in steps})).alias(f"r{i}") for i in range(len(LADDER))]
        tested = rows.where(~F.col("first") & (F.col("part") == part)).agg(F.count("*").alias("good"), *over).first()
        if passed := climb([tested[f"r{i}"] for i in range(len(LADDER))], tested.good):
            out[part] = {rule: rungs[part, rule][passed - 1] for rule in steps}
    return out


def _over(cutoffs: dict[str, int]) -> Column:
    out = F.lit(False)
    for rule, at in cutoffs.items():
        out = out | (F.col(rule) > at)
    return out


def rejected(counts: Column, cutoffs: dict[int, dict[str, int]]) -> Column:
    """Whether any rule's statistic is over its stratum's cutoff."""
    out, stats_of, part = F.lit(False), statistics(counts), stratum(counts)
    for i, by_rule in cutoffs.items():
        for rule, at in by_rule.items():
            out = out | ((part == i) & (step(stats_of[rule]) > at))
    return out


def measure(text: Column) -> Column:
    return arrow_column(lambda: stats, STATS)(text)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts, base_failed and kept of every row; the counts are checkpointed, as two passes need them."""
    measured = checkpoint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), measure(F.col(f"`{text}`")).alias("counts")))
    counts = F.col("counts")
    failed = base_failed(counts)
    return measured.select("doc_id", "counts", failed.alias("base_failed"), (~failed & ~rejected(counts, thresholds(measured, labels))).alias("kept"))
