"""Penalised spline smoothing of many series at once.

A row touches four neighbouring basis functions, so the normal equations of a Gaussian smooth are built-in sums per series
and knot interval, and the fit at a step is four products again. In between, one row per series carries a banded system;
a task solves the systems of a whole batch of series, for all penalties, by one banded Cholesky factorisation over arrays.
The binomial smooth reweights its systems in the same way, with one row of counts per series. The amount of smoothing is a
fixed penalty or the best of a small grid; a likelihood-based choice would differ slightly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .joins import attach, natural_join
from .panel import distinct_values

PENALTIES = tuple(10.0**k for k in range(-3, 7))
# Reweighting ends when no fitted logit moves by more than this; that many steps without it are an error.
IRLS_MOVE, IRLS_STEPS = 1e-8, 2000
# Basis functions on one interval, and so the width of a band.
BAND = 4
# Numbers that the arrays of one batch of systems may hold.
BATCH_CELLS = 4_000_000


def spline_basis(x: np.ndarray, low: float, high: float, size: int) -> np.ndarray:
    """Values of ``size`` B-splines with evenly spaced knots over [low, high].

    They are cubic; fewer than four are a constant, two straight lines or three parabolas.
    """
    degree = min(3, size - 1)
    step = max(high - low, 1e-9) / (size - degree)
    u = (np.asarray(x, dtype=float) - low) / step
    cell = np.clip(np.floor(u), 0, size - degree - 1).astype(int)
    s = u - cell
    local = [np.ones_like(s)]
    for d in range(1, degree + 1):
        # the recursion over degrees; function k of degree d begins d - k intervals before this one
        local = [
            ((s + d - k) / d * local[k - 1] if k else 0) + ((k + 1 - s) / d * local[k] if k < d else 0) for k in range(d + 1)
        ]
    out = np.zeros((len(u), size))
    for k, values in enumerate(local):
        out[np.arange(len(u)), cell + k] = values
    return out


def cubic_basis(x: np.ndarray, low: float, high: float, size: int) -> np.ndarray:
    return spline_basis(x, low, high, max(size, BAND))


def roughness(size: int, ridge: float = 0.0) -> np.ndarray:
    """Squares of second differences of the coefficients; none for fewer than three."""
    d = np.diff(np.eye(size), n=2, axis=0) if size > 2 else np.zeros((0, size))
    return d.T @ d + ridge * np.eye(size)


def bands(matrix: np.ndarray) -> np.ndarray:
    """``[k, j]`` = element (j + k, j) of a symmetric matrix with ``BAND`` diagonals."""
    size = len(matrix)
    out = np.zeros((BAND, size))
    for k in range(min(BAND, size)):
        out[k, : size - k] = np.diagonal(matrix, -k)
    return out


def banded_cholesky(a: np.ndarray) -> np.ndarray:
    """Cholesky factors of symmetric banded matrices ``a[..., k, j]``, all of them side by side."""
    size, lower = a.shape[-1], np.zeros_like(a)
    for j in range(size):
        for k in range(min(BAND, size - j)):
            value = a[..., k, j].copy()
            for m in range(1, min(BAND - k, j + 1)):
                value -= lower[..., m + k, j - m] * lower[..., m, j - m]
            lower[..., k, j] = np.sqrt(np.maximum(value, 1e-300)) if k == 0 else value / lower[..., 0, j]
    return lower


def banded_solve(lower: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions for right sides ``right[..., j, r]``, given ``banded_cholesky``'s factors."""
    size, x = lower.shape[-1], np.array(right, dtype=float)
    for j in range(size):
        for m in range(1, min(BAND, j + 1)):
            x[..., j, :] -= lower[..., m, j - m, None] * x[..., j - m, :]
        x[..., j, :] /= lower[..., 0, j, None]
    for j in reversed(range(size)):
        for m in range(1, min(BAND, size - j)):
            x[..., j, :] -= lower[..., m, j, None] * x[..., j + m, :]
        x[..., j, :] /= lower[..., 0, j, None]
    return x


def banded_product(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Symmetric banded matrices times vectors ``x[..., j]``."""
    size = a.shape[-1]
    out = a[..., 0, :] * x
    for k in range(1, min(BAND, size)):
        out[..., k:] += a[..., k, : size - k] * x[..., : size - k]
        out[..., : size - k] += a[..., k, : size - k] * x[..., k:]
    return out


def _inverse(lower: np.ndarray) -> np.ndarray:
    size = lower.shape[-1]
    return banded_solve(lower, np.broadcast_to(np.eye(size), (*lower.shape[:-2], size, size)))


def _banded_trace(inverse: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Trace of ``inverse`` times a symmetric banded matrix."""
    total = np.einsum("...jj,...j->...", inverse, a[..., 0, :])
    for k in range(1, min(BAND, a.shape[-1])):
        total += 2 * np.einsum("...j,...j->...", np.diagonal(inverse, -k, -2, -1), a[..., k, : a.shape[-1] - k])
    return total


def gaussian_fits(gram, right, wyy, n, penalties, ridge):
    """Coefficients, banded covariances and the penalty, for each system's penalty with the lowest cross-validation score.

    Penalties are given in units of a system's mean diagonal and returned as they weigh. ``gram``: series by band by coefficient, ``right``: series by coefficient, ``wyy`` and ``n``: series.
    """
    size = gram.shape[-1]
    scale = gram[:, 0].sum(1) / size
    scale = np.where(scale > 0, scale, 1.0)
    values = np.asarray(penalties)[None, :, None, None]
    # The last summand decides only what neither data nor penalty do.
    faint = np.zeros((BAND, size))
    faint[0] = 1.0
    systems = gram[:, None] + scale[:, None, None, None] * (values * bands(roughness(size, ridge)) + (1e-11 + 1e-14 * values) * faint)
    lower = banded_cholesky(systems)
    beta = banded_solve(lower, np.broadcast_to(right[:, None, :, None], (*lower.shape[:2], size, 1)))[..., 0]
    inverse = _inverse(lower)
    edf = _banded_trace(inverse, np.broadcast_to(gram[:, None], systems.shape))
    fitted = (beta * banded_product(np.broadcast_to(gram[:, None], systems.shape), beta)).sum(-1)
    rss = np.maximum(wyy[:, None] - 2 * (beta * right[:, None]).sum(-1) + fitted, 0.0)
    free = np.maximum(n[:, None] - edf, 1e-9)
    best = np.argmin(n[:, None] * rss / free**2, axis=1)
    rows = np.arange(len(gram))
    inverse = inverse[rows, best] * (rss / free)[rows, best][:, None, None]
    covariance = np.zeros_like(gram)
    for k in range(min(BAND, size)):
        covariance[:, k, : size - k] = np.diagonal(inverse, -k, -2, -1)
    return beta[rows, best], covariance, scale * np.asarray(penalties)[best]


def binomial_fits(basis, success, n, penalties):
    """Coefficients on the logit scale by weighted least squares, repeated until no fit moves.

    ``basis``: series by step by coefficient, where a series may leave columns empty; ``success`` and ``n``: series by step,
    0 where nothing was observed. Systems that stand still are left out of further steps.
    """
    series, steps, size = basis.shape
    used = np.abs(basis).sum(1) > 0  # columns of a series
    rough = np.zeros((series, BAND, size))
    for i, columns in enumerate(used.sum(1)):
        rough[i, :, :columns] = bands(roughness(int(columns)))
    products = np.stack([np.pad(basis[..., k:] * basis[..., : size - k], ((0, 0), (0, 0), (0, k))) for k in range(min(BAND, size))], axis=1)
    which, value = (x.ravel() for x in np.meshgrid(np.arange(series), np.asarray(penalties), indexing="ij"))
    seen = n > 0
    share = np.where(seen, success / np.where(seen, n, 1), 0.0)
    eta = np.log((success + 0.5) / (n - success + 0.5))[which]
    beta, edf = np.zeros((len(which), size)), np.zeros(len(which))
    moving = np.arange(len(which))
    for _ in range(IRLS_STEPS):
        at = which[moving]
        mu = np.clip(1 / (1 + np.exp(-eta[moving])), 1e-9, 1 - 1e-9)
        weight = n[at] * mu * (1 - mu)
        right = np.einsum("mt,mtk->mk", weight * eta[moving] + success[at] - n[at] * mu, basis[at])
        gram = np.zeros((len(moving), BAND, size))
        for k in range(products.shape[1]):
            gram[:, k] = np.einsum("mt,mtk->mk", weight, products[at, k])
        system = gram + value[moving, None, None] * rough[at]
        system[:, 0] += np.where(used[at], 1e-12 * (1 + system[:, 0].max(1, keepdims=True)), 1.0)
        lower = banded_cholesky(system)
        beta[moving] = banded_solve(lower, right[..., None])[..., 0]
        after = np.clip(np.einsum("mtk,mk->mt", basis[at], beta[moving]), -30, 30)
        still = np.where(seen[at], np.abs(after - eta[moving]), 0.0).max(1) < IRLS_MOVE
        eta[moving] = after
        if still.any():
            edf[moving[still]] = _banded_trace(_inverse(lower[still]), gram[still])
            moving = moving[~still]
        if not len(moving):
            break
    else:
        raise RuntimeError(f"the binomial smooth did not settle in {IRLS_STEPS} steps")
    mu = np.clip(1 / (1 + np.exp(-eta)), 1e-12, 1 - 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = np.where(share[which] > 0, share[which] * np.log(share[which] / mu), 0.0)
        miss = np.where(share[which] < 1, (1 - share[which]) * np.log((1 - share[which]) / (1 - mu)), 0.0)
    deviance = 2 * (n[which] * (hit + miss)).sum(1)
    score = ((deviance + 2 * edf) / seen.sum(1)[which]).reshape(series, -1)
    best = np.argmin(score, axis=1)
    return beta.reshape(series, -1, size)[np.arange(series), best]


def _local(x: Column, low: Column, high: Column, size: int) -> tuple[Column, list[Column]]:
    """The interval of a value and its four cubic basis functions there."""
    u = (x - low) / (F.greatest(high - low, F.lit(1e-9)) / F.lit(float(size - 3)))
    cell = F.least(F.greatest(F.floor(u), F.lit(0)), F.lit(size - BAND)).cast("int")
    s = u - cell
    rest = 1 - s
    values = [rest * rest * rest, 3 * s * s * s - 6 * s * s + 4, 3 * rest * rest * rest - 6 * rest * rest + 4, s * s * s]
    return cell, [v / 6 for v in values]


def _normal_equations(df: DataFrame, key: str, x: str, y: str, weight: str | None, grid: Column, size: int) -> DataFrame:
    """One row per series: ``cells`` with the sums over the rows of each knot interval."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w"), grid.alias("grid")
    )
    cell, local = _local(F.col("x"), F.get("grid", F.lit(0)), F.element_at("grid", -1), size)
    rows = rows.select(key, "y", "w", cell.alias("cell"), *[b.alias(f"b{a}") for a, b in enumerate(local)])
    squares = [F.sum(F.col("w") * F.col(f"b{a}") * F.col(f"b{b}")).alias(f"g{a}{b}") for a in range(BAND) for b in range(a, BAND)]
    rights = [F.sum(F.col("w") * F.col("y") * F.col(f"b{a}")).alias(f"r{a}") for a in range(BAND)]
    sums = rows.groupBy(key, "cell").agg(*squares, *rights, F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(key).agg(F.collect_list(F.struct(*[c for c in sums.columns if c != key])).alias("cells"))


def _flat(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row numbers and fields of the structs in a column of lists."""
    items = column.flatten()
    rows = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return rows, {f.name: items.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(items.type)}


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))


def _solved(equations: DataFrame, key: str, size: int, penalties: tuple[float, ...], ridge: float) -> DataFrame:
    """``key, beta, spread, penalty``: coefficients, the bands of their covariance, band after band, and the chosen penalty."""
    key_type = equations.schema[key].dataType.simpleString()
    at_once = max(1, BATCH_CELLS // (len(penalties) * size * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                rows, sums = _flat(batch.column("cells"))
                gram, right = np.zeros((batch.num_rows, BAND, size)), np.zeros((batch.num_rows, size))
                wyy, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for a in range(BAND):
                    np.add.at(right, (rows, sums["cell"] + a), sums[f"r{a}"])
                    for b in range(a, BAND):
                        np.add.at(gram, (rows, b - a, sums["cell"] + a), sums[f"g{a}{b}"])
                np.add.at(wyy, rows, sums["wyy"])
                np.add.at(n, rows, sums["n"])
                beta, covariance, chosen = gaussian_fits(gram, right, wyy, n, penalties, ridge)
                columns = [batch.column(key), _lists(beta), _lists(covariance.reshape(len(beta), -1)), pa.array(chosen)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "beta", "spread", "penalty"])

    return equations.select(key, "cells").mapInArrow(run, f"`{key}` {key_type}, beta array<double>, spread array<double>, penalty double")


def _evaluated(cell: Column, local: list[Column], beta: str, spread: str, size: int) -> tuple[Column, Column]:
    """Fit and variance where four basis functions of a curve meet."""
    fit, variance = F.lit(0.0), F.lit(0.0)
    for a in range(BAND):
        fit = fit + local[a] * F.get(beta, cell + a)
        for b in range(a, BAND):
            term = local[a] * local[b] * F.get(spread, F.lit((b - a) * size) + cell + a)
            variance = variance + (term if a == b else 2 * term)
    return fit, F.greatest(variance, F.lit(0.0))


def spline_smooth(
    df: DataFrame,
    key: str,
    x: str,
    y: str,
    knots: int = 10,
    penalty: float | None = None,
    weight: str | None = None,
    ridge: float = 0.0,
) -> DataFrame:
    """Smooth series per entity, at every time step of the table -> key, x, fit, se_fit."""
    penalties = PENALTIES if penalty is None else (penalty,)
    size = max(knots, BAND)
    grid = distinct_values(df, x).cast("array<double>")
    solved = _solved(_normal_equations(df, key, x, y, weight, grid, size), key, size, penalties, ridge)
    steps = solved.withColumn("grid", grid).select(key, "beta", "spread", F.get("grid", F.lit(0)).alias("low"), F.element_at("grid", -1).alias("high"), F.explode("grid").alias("at"))
    cell, local = _local(F.col("at"), F.col("low"), F.col("high"), size)
    steps = steps.select(key, "beta", "spread", "at", cell.alias("cell"), *[b.alias(f"b{a}") for a, b in enumerate(local)])
    fit, variance = _evaluated(F.col("cell"), [F.col(f"b{a}") for a in range(BAND)], "beta", "spread", size)
    return steps.select(key, F.col("at").cast(df.schema[x].dataType).alias(x), fit.alias("fit"), F.sqrt(variance).alias("se_fit"))


def binomial_smooth(
    df: DataFrame, key: str, x: str, success: str, n: str, knots: int = 5, penalty: float | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """Smooth share of successes per entity on the logit scale -> key, x, fit.

    ``sizes`` (key, size) gives entities a number of basis functions of their own, 1 or more; the others have ``knots``, at
    least four.
    """
    penalties = PENALTIES if penalty is None else (penalty,)
    known = df.filter(F.col(x).isNotNull() & F.col(success).isNotNull() & (F.col(n) > 0))
    steps = known.groupBy(key, F.col(x).cast("double").alias("x")).agg(F.sum(F.col(success).cast("double")).alias("success"), F.sum(F.col(n).cast("double")).alias("n"))
    series = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("x", "success", "n"))).alias("steps"))
    series = series.withColumn("size", F.lit(None).cast("int")) if sizes is None else natural_join(series, sizes.select(key, F.col("size").cast("int")), [key])
    series = series.withColumn("size", F.greatest(F.coalesce("size", F.lit(max(knots, BAND))), F.lit(1))).withColumn("grid", distinct_values(df, x).cast("array<double>"))
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            grid = whole.column("grid").slice(0, 1).flatten().to_numpy()
            most = int(max(whole.column("size").to_numpy().max(), 1))
            at_once = max(1, BATCH_CELLS // (len(penalties) * len(grid) * most * BAND))
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                rows, found = _flat(batch.column("steps"))
                size = batch.column("size").to_numpy()
                basis = np.zeros((batch.num_rows, len(grid), most))
                for k in np.unique(size):
                    basis[size == k, :, :k] = spline_basis(grid, grid[0], grid[-1], int(k))
                counts = np.zeros((2, batch.num_rows, len(grid)))
                place = np.searchsorted(grid, found["x"])
                counts[0, rows, place], counts[1, rows, place] = found["success"], found["n"]
                beta = binomial_fits(basis, counts[0], counts[1], penalties)
                fit = 1 / (1 + np.exp(-np.einsum("stk,sk->st", basis, beta)))
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("grid"), _lists(fit)], names=[key, "grid", "fit"])

    fitted = series.select(key, "steps", "size", "grid").mapInArrow(run, f"`{key}` {key_type}, grid array<double>, fit array<double>")
    rows = fitted.select(key, F.inline(F.arrays_zip("grid", "fit")))
    return rows.select(key, F.col("grid").cast(df.schema[x].dataType.simpleString()).alias(x), "fit")


def smooth_observed(df: DataFrame, key: str, x: str, y: str, **options) -> DataFrame:
    """The rows with a known value, with their smooth value next to it -> + fit, se_fit."""
    known = df.filter(F.col(y).isNotNull())
    return attach(known, spline_smooth(known, key, x, y, **options), [key, x])


def _joint_equations(known: DataFrame, group: str, entity: str, x: str, y: str, weight: str, grid: Column, wide: int, narrow: int) -> DataFrame:
    """One row per entity: the sums of the trend's basis, of its own one, and of both together, by pair of intervals."""
    at, low, high = F.col("x"), F.get("grid", F.lit(0)), F.element_at("grid", -1)
    rows = known.select(group, entity, at_double(x).alias("x"), at_double(y).alias("y"), at_double(weight).alias("w"), grid.alias("grid"))
    trend_cell, trend = _local(at, low, high, wide)
    own_cell, own = _local(at, low, high, narrow)
    rows = rows.select(group, entity, "y", "w", trend_cell.alias("cell"), own_cell.alias("own"), *[b.alias(f"b{a}") for a, b in enumerate(trend)], *[d.alias(f"d{a}") for a, d in enumerate(own)])
    product = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))
    pairs = [(a, b) for a in range(BAND) for b in range(a, BAND)]
    sums = rows.groupBy(group, entity, "cell", "own").agg(
        *[product(f"b{a}", f"b{b}").alias(f"g{a}{b}") for a, b in pairs],
        *[product(f"d{a}", f"d{b}").alias(f"h{a}{b}") for a, b in pairs],
        *[product(f"b{a}", f"d{b}").alias(f"c{a}{b}") for a in range(BAND) for b in range(BAND)],
        *[product(f"b{a}", "y").alias(f"r{a}") for a in range(BAND)],
        *[product(f"d{a}", "y").alias(f"s{a}") for a in range(BAND)],
        product("y", "y").alias("wyy"),
        F.count(F.lit(1)).alias("n"),
    )
    return sums.groupBy(group, entity).agg(F.collect_list(F.struct(*[c for c in sums.columns if c not in (group, entity)])).alias("cells"))


def at_double(column: str) -> Column:
    return F.col(column).cast("double")


def _own_systems(batch: pa.RecordBatch, wide: int, narrow: int, penalties: tuple[float, ...], ridge: float):
    """Arrays of a batch of entities, and the factors of their own systems at the penalty that suits what the trend leaves."""
    rows, sums = _flat(batch.column("cells"))
    count = batch.num_rows
    gram, own, cross = np.zeros((count, BAND, wide)), np.zeros((count, BAND, narrow)), np.zeros((count, wide, narrow))
    right, own_right, wyy, n = np.zeros((count, wide)), np.zeros((count, narrow)), np.zeros(count), np.zeros(count)
    for a in range(BAND):
        np.add.at(right, (rows, sums["cell"] + a), sums[f"r{a}"])
        np.add.at(own_right, (rows, sums["own"] + a), sums[f"s{a}"])
        for b in range(BAND):
            np.add.at(cross, (rows, sums["cell"] + a, sums["own"] + b), sums[f"c{a}{b}"])
            if b >= a:
                np.add.at(gram, (rows, b - a, sums["cell"] + a), sums[f"g{a}{b}"])
                np.add.at(own, (rows, b - a, sums["own"] + a), sums[f"h{a}{b}"])
    np.add.at(wyy, rows, sums["wyy"])
    np.add.at(n, rows, sums["n"])
    trend = np.stack(batch.column("beta").to_numpy(zero_copy_only=False))
    left = own_right - np.einsum("ewk,ew->ek", cross, trend)
    left_square = wyy - 2 * (trend * right).sum(1) + (trend * banded_product(gram, trend)).sum(1)
    _, covariance, penalty = gaussian_fits(own, left, left_square, n, penalties, ridge)
    faint = 1e-11 * np.maximum(own[:, 0].mean(1), 1e-300)
    system = own + penalty[:, None, None] * bands(roughness(narrow, ridge))
    system[:, 0] += faint[:, None]
    return gram, cross, right, own_right, covariance, banded_cholesky(system)


def _slices(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    size = max(1, BATCH_CELLS // cells)
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def panel_smooth(
    panel: DataFrame,
    group: str,
    entity: str,
    x: str,
    y: str,
    weight: str,
    group_knots: int = 30,
    entity_knots: int = 15,
    ridge: float = 1.0,
    alone_knots: int = 20,
    group_penalty: float | None = None,
    entity_penalty: float | None = None,
) -> DataFrame:
    """Sample-weighted trend of the group plus the entity's shrunken deviation -> group, entity, x, fit, se_fit.

    Both are fitted together: the weighted squares of what is left, the roughness of the trend, and the roughness and size
    of every deviation have their least sum. Penalties that are not given are those of the trend alone and of each
    deviation from it. An entity alone in its group has a smooth of ``alone_knots`` of its own and no trend beside it; the
    number of entities does not matter otherwise. The standard error takes trend and deviation as independent.

    Dense: an entity gets a value for every time step of its group, also where it was not observed.
    """
    known = panel.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(weight).isNotNull())
    members = known.select(group, entity).distinct()
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("__members"))
    alone = attach(known, sizes.filter("__members = 1").drop("__members"), [group], "inner")
    single = spline_smooth(alone, group, x, y, alone_knots, group_penalty, weight)
    steps = known.groupBy(group).agg(F.collect_set(x).alias(x))
    lonely = attach(members, sizes.filter("__members = 1").drop("__members"), [group], "inner")
    lonely = natural_join(natural_join(lonely, steps, [group], "inner").withColumn(x, F.explode(x)), single, [group, x])

    wide, narrow = max(group_knots, BAND), max(entity_knots, BAND)
    grid = distinct_values(known, x).cast("array<double>")
    many = attach(known, sizes.filter("__members > 1").drop("__members"), [group], "inner")
    equations = settle(_joint_equations(many, group, entity, x, y, weight, grid, wide, narrow), "panel-equations")
    cells = equations.select(group, F.inline("cells"))
    names = [c for c in cells.columns if c[0] in "gr" and c[1:].isdigit()] + ["wyy", "n"]
    by_group = cells.groupBy(group, "cell").agg(*[F.sum(c).alias(c) for c in names])
    by_group = by_group.groupBy(group).agg(F.collect_list(F.struct("cell", *names)).alias("cells"))
    trend = settle(_solved(by_group, group, wide, PENALTIES if group_penalty is None else (group_penalty,), 0.0), "panel-trend")
    penalties = PENALTIES if entity_penalty is None else (entity_penalty,)
    group_type = panel.schema[group].dataType.simpleString()
    entity_type = panel.schema[entity].dataType.simpleString()
    volume = len(penalties) * narrow * narrow + wide * (wide + narrow)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the entities of a batch leave of their group's system once their own curves are solved for."""
        for batch in _slices(batches, volume):
            gram, cross, right, own_right, _, lower = _own_systems(batch, wide, narrow, penalties, ridge)
            solved = banded_solve(lower, np.concatenate([cross.transpose(0, 2, 1), own_right[..., None]], axis=2))
            matrix = -np.einsum("ewk,ekv->ewv", cross, solved[..., :-1])
            for k in range(min(BAND, wide)):
                j = np.arange(wide - k)
                matrix[:, j + k, j] += gram[:, k, : wide - k]
                if k:
                    matrix[:, j, j + k] += gram[:, k, : wide - k]
            vector = right - np.einsum("ewk,ek->ew", cross, solved[..., -1])
            flat = np.concatenate([matrix.reshape(len(matrix), -1), vector], axis=1)
            codes = batch.column(group).dictionary_encode()
            places = codes.indices.to_numpy(zero_copy_only=False)
            sums = np.zeros((len(codes.dictionary), flat.shape[1]))
            np.add.at(sums, places, flat)
            yield pa.RecordBatch.from_arrays([codes.dictionary, _lists(sums)], names=[group, "sums"])

    def joint_trend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, wide * wide):
            sums = np.stack([np.asarray(v) for v in batch.column("sums").to_pylist()])
            matrix, vector = sums[:, :-wide].reshape(-1, wide, wide), sums[:, -wide:]
            scale = np.maximum(np.einsum("gjj->g", matrix) / wide, 1e-300)
            matrix = matrix + batch.column("penalty").to_numpy()[:, None, None] * roughness(wide) + 1e-11 * scale[:, None, None] * np.eye(wide)
            yield pa.RecordBatch.from_arrays([batch.column(group), _lists(np.linalg.solve(matrix, vector[..., None])[..., 0])], names=[group, "joint"])

    def deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, volume):
            _, cross, _, own_right, covariance, lower = _own_systems(batch, wide, narrow, penalties, ridge)
            joint = np.stack(batch.column("joint").to_numpy(zero_copy_only=False))
            own = banded_solve(lower, (own_right - np.einsum("ewk,ew->ek", cross, joint))[..., None])[..., 0]
            columns = [batch.column(group), batch.column(entity), batch.column("joint"), batch.column("spread"), _lists(own), _lists(covariance.reshape(len(own), -1))]
            yield pa.RecordBatch.from_arrays(columns, names=[group, entity, "joint", "spread", "own", "own_spread"])

    with_trend = natural_join(equations, trend, [group], "inner")
    parts = with_trend.select(group, "cells", "beta").mapInArrow(reduced, f"`{group}` {group_type}, sums array<double>")
    sums = parts.select(group, F.posexplode("sums").alias("at", "value")).groupBy(group, "at").agg(F.sum("value").alias("value"))
    sums = sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda v: v["value"]).alias("sums"))
    joint = natural_join(sums, trend.select(group, "penalty"), [group], "inner").mapInArrow(joint_trend, f"`{group}` {group_type}, joint array<double>")
    curves = natural_join(with_trend, joint, [group], "inner").select(group, entity, "cells", "beta", "spread", "joint")
    curves = curves.mapInArrow(deviations, f"`{group}` {group_type}, `{entity}` {entity_type}, joint array<double>, spread array<double>, own array<double>, own_spread array<double>")
    rows = natural_join(curves, steps, [group], "inner").withColumn("grid", grid).withColumn(x, F.explode(x))
    low, high = F.get("grid", F.lit(0)), F.element_at("grid", -1)
    trend_cell, trend_local = _local(at_double(x), low, high, wide)
    own_cell, own_local = _local(at_double(x), low, high, narrow)
    rows = rows.select(
        group, entity, x, "joint", "spread", "own", "own_spread", trend_cell.alias("__cell"), own_cell.alias("__own_cell"),
        *[b.alias(f"__b{a}") for a, b in enumerate(trend_local)], *[d.alias(f"__d{a}") for a, d in enumerate(own_local)],
    )
    fit, variance = _evaluated(F.col("__cell"), [F.col(f"__b{a}") for a in range(BAND)], "joint", "spread", wide)
    own_fit, own_variance = _evaluated(F.col("__own_cell"), [F.col(f"__d{a}") for a in range(BAND)], "own", "own_spread", narrow)
    dense = rows.select(group, entity, x, (fit + own_fit).alias("fit"), F.sqrt(variance + own_variance).alias("se_fit"))
    return dense.unionByName(lonely.select(dense.columns))
