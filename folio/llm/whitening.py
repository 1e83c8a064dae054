"""Embedding whitening by block Lanczos, with nothing of the covariance ever held.

Vectors are put on a grid of whole numbers, x = floor(GRID * c) + OFFSET, and the distinct ones are the fit list. A pass
over it gives the centred product V q of the covariance with a block of directions: every task centres its vectors,
multiplies twice, and sends on a matrix of dimensions by block, which are added up by place. The block's part outside
the directions so far, orthogonalised twice against all of them, is the next block; where nothing is left of a
direction (breakdown) a random one begins anew. Ritz pairs come from the products that are kept, so that their residuals are
exact; the passes end when the residuals of the components asked for are at rounding, or when the directions fill the
space. Beyond MOST_BLOCKS blocks the basis is shortened to the leading Ritz vectors (thick restart).

The deviation of a row is sum((n * x - S)^2), a whole number; their sum over the fit list is n^3 times the trace of V, which
gives the shares that components explain.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped, and so are those whose length isn't
the commonest one (of equally common lengths the greatest; empty vectors have none); entries are held to +-2^53 on the grid;
equal vectors count once in the fit, and rows that repeat an id or a vector each get their rows; a component without variance
(eigenvalue under 1e-12 of the greatest) isn't given, so that a single vector or an empty table gives no rows; a
deviation is a decimal here, of 38 digits; other columns may be there, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import arrow_column, checkpoint

#: The grid's steps in a unit and the whole number that is added.
GRID, OFFSET = 64, 1_000_000
#: Components asked for, directions of a block beyond them, blocks of the basis, and passes at most.
COMPONENTS, BEYOND, MOST_BLOCKS, PASSES = 16, 8, 12, 200
#: A residual at rounding, as a share of the greatest eigenvalue; a direction of which less is left broke down.
ROUNDING, BROKEN = 2e-15, 1e-10
#: A component with less than this share of the greatest eigenvalue has no variance.
NOTHING = 1e-12
#: Vectors taken at a time.
ROWS = 1024
HELD_TO = 1 << 53


@dataclass
class Fit:
    """The fit list's size and sums, its components (columns) and eigenvalues, and the covariance's trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0


def on_grid(vector: Column) -> Column:
    """The whole numbers of a vector of finite entries."""
    held = F.lit(float(HELD_TO))
    return F.transform(vector, lambda c: F.greatest(F.least(F.floor(c.cast("double") * GRID).cast("double"), held), -held).cast("long") + OFFSET)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(~bad & (F.size(vector) > 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers; all lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S / n, S / n being a whole base and a rest of under one, so that nothing is lost in the difference."""
    return (x - base).astype(np.float64) - rest


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def _summed(per_batch):
    """A mapper that adds up a matrix over a task's batches of vectors and gives its entries by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = per_batch(_matrix(batch.column(0).slice(lo, ROWS)))
                total = part if total is None else total + part
        if total is not None:
            flat = total.ravel()
            yield pa.record_batch([pa.array(np.arange(len(flat), dtype=np.int64)), pa.array(flat)], names=["place", "value"])

    return run


def _total(fit_list: DataFrame, per_batch, shape: tuple[int, ...]) -> np.ndarray:
    """The matrix's sum over the whole list; tasks' parts are added up by place before they come to the driver."""
    sums = fit_list.select("x").mapInArrow(_summed(per_batch), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(math.prod(shape))
    out[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    return out.reshape(shape)


def _product(n: int, sums: list[int], block: np.ndarray):
    base, rest = _centre(n, sums)

    def per_batch(x: np.ndarray) -> np.ndarray:
        c = _centred(x, base, rest)
        return c.T @ (c @ block)

    return per_batch


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """As many orthonormal directions outside the basis as there are, up to the block's number: the block's own, then random ones."""
    out = basis
    room = min(block.shape[1], len(block) - basis.shape[1])
    tries = [block[:, i] for i in range(block.shape[1])]
    while out.shape[1] < basis.shape[1] + room:
        v = tries.pop(0) if tries else rng.standard_normal(len(block))
        length = np.linalg.norm(v)
        if not length:
            continue
        v = v / length
        left = 1.0
        for _ in range(3):  # full reorthogonalisation, again and again until nothing changes
            v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            left *= size
            if left < BROKEN:
                break
            v = v / size
            if size > 0.7:
                break
        if left >= BROKEN:  # else it broke down
            out = np.concatenate((out, v[:, None]), axis=1)
    return out[:, basis.shape[1] :]


def lanczos(product, size: int, wanted: int, beyond: int = BEYOND, most_blocks: int = MOST_BLOCKS, passes: int = PASSES, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and unit eigenvectors (columns) of a symmetric operator; `product` gives its product with a block."""
    rng = np.random.default_rng(seed)
    width = min(size, wanted + beyond)
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    block, best, stale = rng.standard_normal((size, width)), np.inf, 0
    for _ in range(passes):
        block = _orthonormal(block, basis, rng)
        basis = np.concatenate((basis, block), axis=1)
        image = np.concatenate((image, product(block)), axis=1)
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        lead = turns[:, :width]
        residual = image @ lead - (basis @ lead) * values[: lead.shape[1]]
        worst = np.linalg.norm(residual[:, :wanted], axis=0).max() / max(values[0], np.finfo(float).tiny)
        stale = 0 if worst < best / 2 else stale + 1
        best = min(best, worst)
        if worst <= ROUNDING or basis.shape[1] == size or best < 1e-12 and stale > 2:
            break
        if basis.shape[1] + width > most_blocks * width:
            basis, image = _shortened(basis, image, turns[:, : 2 * width])
            block = residual
        else:
            # the newest products, less what lies in the basis, are the next block
            block = image[:, -block.shape[1] :]
    vectors = basis @ turns[:, :wanted]
    return values[:wanted], vectors / np.linalg.norm(vectors, axis=0)


def _shortened(basis: np.ndarray, image: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return basis @ turns, image @ turns


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """sum((n * x - S)^2) of each row, exact: in 64 bits where they suffice."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], object)  # S = n * base + rest
    near = x - base
    most = int(np.abs(near).max(initial=0)) + 1
    if (n * most) ** 2 * len(sums) < 1 << 62:
        apart = near * n - rest.astype(np.int64)
        return (apart * apart).sum(axis=1)
    apart = near.astype(object) * n - rest
    return (apart * apart).sum(axis=1)


def _whitened(fit: Fit):
    """What gives a vector's deviation and whitened values."""
    base, rest = _centre(fit.n, fit.sums)
    turn = fit.vectors / np.sqrt(fit.values)

    def run(column: pa.Array) -> pa.Array:
        deviations, values = [], []
        for lo in range(0, len(column), ROWS):
            x = _matrix(column.slice(lo, ROWS))
            deviations += [Decimal(int(d)) for d in _deviations(x, fit.n, fit.sums)]
            values.append(_centred(x, base, rest) @ turn)
        flat = np.concatenate(values).ravel() if values else np.zeros(0)
        offsets = np.arange(0, len(flat) + 1, turn.shape[1], dtype=np.int32) if len(flat) else np.zeros(1, np.int32)
        return pa.StructArray.from_arrays([pa.array(deviations, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["deviation", "whitened"])

    return run


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of a list of distinct vectors (column x: whole numbers, all of one length); none where nothing varies."""
    n = fit_list.count()
    if not n:
        return None
    exact = fit_list.select(F.posexplode("x").alias("place", "value")).groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).toArrow()
    by_place = dict(zip(exact.column("place").to_pylist(), exact.column("value").to_pylist(), strict=True))
    sums = [int(by_place[i]) for i in range(len(by_place))]
    size = len(sums)

    def spread(x: np.ndarray) -> np.ndarray:
        return np.array([float(sum(int(d) for d in _deviations(x, n, sums)))])

    trace = _total(fit_list, spread, (1,))[0] / n / n / n
    if not trace > 0:
        return None
    values, vectors = lanczos(lambda block: _total(fit_list, _product(n, sums, block), (size, block.shape[1])) / n, size, min(components, size))
    kept = values > NOTHING * values[0]
    out = Fit(n, sums, vectors[:, kept], values[kept], trace)
    base, rest = _centre(n, sums)
    turn = out.vectors / np.sqrt(out.values)
    k = turn.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, base, rest) @ turn
        return np.concatenate((w.T @ w, w.sum(axis=0)[None]))

    found = _total(fit_list, moments, (k + 1, k)) / n
    out.identity_error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return out


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, out: str = "component") -> DataFrame:
    """A row of `rows` (its other columns) for each usable vector and component, with a struct `out` of its results."""
    spark = rows.sparkSession
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (vector, out)]
    given = rows.where(usable(F.col(f"`{vector}`"))).select(F.struct(*kept).alias("row") if kept else F.struct(F.lit(0).alias("__none")).alias("row"), on_grid(F.col(f"`{vector}`")).alias("x"))
    lengths = given.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    given = given.where(F.size("x") == (lengths.length if lengths else 0))
    found = fit(checkpoint(given.select("x").distinct()), components)
    kind = "struct<component: int, n: long, deviation: decimal(38,0), whitened: double, explained: double, identity_error: double>"
    if found is None:
        return given.limit(0).select("row.*", F.lit(None).cast(kind).alias(out)) if kept else given.limit(0).select(F.lit(None).cast(kind).alias(out))
    model = spark.sparkContext.broadcast(found)
    done = given.select("row", arrow_column(lambda: _whitened(model.value), "deviation decimal(38,0), whitened array<double>", cut=False)(F.col("x")).alias("w"))
    shares = F.array(*(F.lit(float(v / found.trace)) for v in found.values))
    each = done.select("row", F.col("w.deviation").alias("deviation"), F.posexplode("w.whitened").alias("at", "value"))
    result = F.struct((F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(found.identity_error).alias("identity_error")).cast(kind).alias(out)
    return each.select("row.*", result) if kept else each.select(result)
