"""Similarity metrics as column expressions, each with the direction in which it is closer."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A query vector as a literal, rounded to single precision as stored keys are."""
    return F.array(*[F.lit(float(np.float32(v))) for v in values]).cast("array<double>")


def _sum(x: Column, y: Column, each: Callable[[Column, Column], Column]) -> Column:
    # double from the first operation on: products of singles are exact
    return F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), each), F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: a * b)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x.cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v))


def cosine(x: Column, y: Column) -> Column:
    """Null where either vector has no direction."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def squared_l2(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: (a - b) * (a - b))


def l2(x: Column, y: Column) -> Column:
    return F.sqrt(squared_l2(x, y))


@dataclass(frozen=True)
class Metric:
    """``score`` of two vectors; ``matrix`` the same for all pairs of rows in numpy."""

    name: str
    score: Callable[[Column, Column], Column]
    greater_is_closer: bool
    matrix: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def order(self, column: str) -> Column:
        """Closest first, scores without a value last."""
        return F.desc_nulls_last(column) if self.greater_is_closer else F.asc_nulls_last(column)

    def closeness(self, score: Column) -> Column:
        return score if self.greater_is_closer else -score


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By differences, a few rows at a time: no cancellation, bounded memory."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for at in range(0, len(a), step):
        d = a[at : at + step, None, :] - b[None, :, :]
        out[at : at + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_squared(a, b))


def closest(m: Metric, queries: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray,
    leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs that may be among the k closest of their query, ties included.

    ``least``: the closeness below which a query needs no more rows. ``leave``:
    pairs to leave out. Squared distances are first found by a matrix product,
    whose rounding is allowed for, and exactly for what remains.
    """
    by_product = m.matrix in (_squared, _distances)
    if by_product:
        sizes, lengths = np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", rows, rows)
        score = 2 * (queries @ rows.T)
        score -= sizes[:, None]
        score -= lengths[None, :]
        slack = 1e-12 * (sizes + (lengths.max() if len(lengths) else 0)) * max(1, queries.shape[1])
        least = np.where(np.isinf(least), least, -least * least if m.matrix is _distances else least)
    else:
        score = m.matrix(queries, rows)
        score = np.where(np.isnan(score), -np.inf, score if m.greater_is_closer else -score)
        slack = 0
    if leave is not None:
        score[leave] = np.nan
    if score.shape[1] > k and np.isinf(least).any():  # later on what is known to be too far leaves few
        kth = np.partition(np.where(np.isnan(score), -np.inf, score), score.shape[1] - k, 1)[:, score.shape[1] - k]
        least = np.maximum(least, kth)
    q, r = np.nonzero(score >= (least - 2 * slack)[:, None])
    if not by_product:
        return q, r, score[q, r] if m.greater_is_closer else -score[q, r]
    d = queries[q] - rows[r]
    exact = np.einsum("ij,ij->i", d, d)
    return q, r, np.sqrt(exact) if m.matrix is _distances else exact


METRICS = {
    m.name: m
    for m in (
        Metric("cosine", cosine, True, _cosines),
        Metric("dot", dot, True, _dots),
        Metric("euclidean", l2, False, _distances),
        Metric("squared_euclidean", squared_l2, False, _squared),
    )
}


def metric(name: str | Metric) -> Metric:
    return name if isinstance(name, Metric) else METRICS[name]
