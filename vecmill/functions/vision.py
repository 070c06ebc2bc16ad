"""Boxes, faces and images: what stands before and after image models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- boxes as columns: arrays x1, y1, x2, y2


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    common = side(0) * side(1)
    whole = area(a) + area(b) - common
    return F.when(whole > 0, common / F.when(whole > 0, whole)).otherwise(F.lit(0.0))


def unletterbox(box: Column, width: Column, height: Column, size: int) -> Column:
    """A box in a letterboxed square picture as shares of the original's sides, within 0 and 1."""
    scale = F.least(size / width, size / height)
    w, h = F.floor(width * scale), F.floor(height * scale)
    left, top = F.floor((size - w) / 2), F.floor((size - h) / 2)
    within = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.array(within((box[0] - left) / w), within((box[1] - top) / h), within((box[2] - left) / w), within((box[3] - top) / h))


def nms(boxes: DataFrame, threshold: float = 0.4, group: str = "image_id") -> DataFrame:
    """Greedy suppression within each image: (image_id, box, confidence) rows that stay."""

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        found = suppress(np.array(frame["box"].tolist(), np.float64).reshape(-1, 4), frame["confidence"].to_numpy(), threshold)
        return frame.iloc[found]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema)
    return boxes.groupBy(group).applyInPandas(keep, kinds)  # an image's boxes are few


# -- boxes as arrays


def box_ious(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    low, high = np.maximum(box[:2], others[:, :2]), np.minimum(box[2:], others[:, 2:])
    common = np.clip(high - low, 0, None).prod(1)
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    whole = area(box) + area(others) - common
    return np.divide(common, whole, out=np.zeros_like(common), where=whole > 0)


def suppress(boxes: np.ndarray, confidence: np.ndarray, threshold: float) -> list[int]:
    """Indexes that stay, most confident first (of equals the earlier)."""
    left, kept = np.argsort(-confidence, kind="stable"), []
    while len(left):
        best, left = left[0], left[1:]
        kept.append(int(best))
        left = left[box_ious(boxes[best], boxes[left]) <= threshold]
    return kept


def grid(size: int, stride: int, each: int = 1, centre: float = 0.0) -> np.ndarray:
    """(x, y) of every cell of a square picture, row by row, ``each`` times."""
    n = size // stride
    y, x = np.divmod(np.arange(n * n), n)
    return np.repeat(np.stack([x + centre, y + centre], 1) * float(stride), each, 0)


@lru_cache(maxsize=16)
def _grid(size: int, stride: int, each: int) -> np.ndarray:
    """``grid`` for many pictures of one size, not to be written to."""
    out = grid(size, stride, each)
    out.flags.writeable = False
    return out


def decode_distances(outputs: Sequence[np.ndarray], least: float, size: int = 640, strides: Sequence[int] = (8, 16, 32),
    each: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boxes, points, confidence) of a detector that gives distances to a box's sides from grid points.

    For every stride a score, a box and a points tensor, told apart by shape.
    """
    shaped = {o.shape: o for o in outputs}
    boxes, points, scores = [], [], []
    for s in strides:
        at = _grid(size, s, each)
        try:
            score, box, point = (shaped[len(at), k] for k in (1, 4, 10))
        except KeyError as e:
            raise ValueError(f"no output of shape {e} for stride {s}") from None
        good = np.flatnonzero(score[:, 0] >= least)
        good = good[np.isfinite(score[good, 0])]
        c, b = at[good], box[good] * s
        boxes.append(np.concatenate([c - b[:, :2], c + b[:, 2:]], 1))
        points.append(c[:, None, :] + point[good].reshape(-1, 5, 2) * s)
        scores.append(score[good, 0])
    return np.concatenate(boxes), np.concatenate(points), np.concatenate(scores)


def decode_centres(outputs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], least: float,
    size: int = 640) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boxes, points, confidence) of a detector that gives (class, object, box, points) by stride, boxes by centre and sides."""
    boxes, points, scores = [], [], []
    for s, (cls, obj, box, point) in outputs.items():
        at, score = grid(size, s, centre=0.5), cls[:, 0] * obj[:, 0]
        good = score >= least
        centre, half = at[good] + box[good, :2] * s, box[good, 2:] * s / 2
        boxes.append(np.clip(np.concatenate([centre - half, centre + half], 1), 0, size))
        points.append(at[good][:, None, :] + point[good].reshape(-1, 5, 2) * s)
        scores.append(score[good])
    return np.concatenate(boxes), np.concatenate(points), np.concatenate(scores)


def similarity_from_eyes(left: Sequence[float], right: Sequence[float], to_left: Sequence[float], to_right: Sequence[float]) -> np.ndarray:
    """The rotation, scaling and shift (2 x 3) that takes two points to two points."""
    a, b, c, d = (complex(*p) for p in (left, right, to_left, to_right))
    if a == b:
        raise ValueError("the eyes are one point")
    m = (d - c) / (b - a)
    t = c - m * a
    return np.array([[m.real, -m.imag, t.real], [m.imag, m.real, t.imag]])


def warp(picture: np.ndarray, transform: np.ndarray, size: int = 112) -> np.ndarray:
    """The picture (H, W, C) under a 2 x 3 transform, bilinear, black beyond its edges."""
    back = np.linalg.inv(np.vstack([transform, [0, 0, 1]]))[:2]
    y, x = np.mgrid[:size, :size]
    sx, sy = back @ np.stack([x.ravel(), y.ravel(), np.ones(size * size)])
    return _bilinear(picture, sx, sy).reshape(size, size, -1)


def _bilinear(picture: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, w = picture.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((len(x), picture.shape[2]))
    for dx in (0, 1):
        for dy in (0, 1):
            px, py = x0 + dx, y0 + dy
            share = (1 - np.abs(x - px)) * (1 - np.abs(y - py))
            good = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            out[good] += picture[py[good], px[good]] * share[good, None]
    return out


# -- pictures (H, W, C)


@lru_cache(maxsize=4096)
def _between(n: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``wanted`` places along a side of n: the places before and behind it, and the latter's share."""
    at = np.clip((np.arange(wanted) + 0.5) * n / wanted - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, n - 1), (at - low)[:, None, None]


def resize(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, one side after the other."""
    low, high, share = _between(picture.shape[0], height)
    rows = picture[low]
    rows = rows + (picture[high] - rows) * share
    low, high, share = _between(picture.shape[1], width)
    out = rows[:, low]
    return out + (rows[:, high] - out) * share[:, 0]


def letterbox(picture: np.ndarray, size: int) -> np.ndarray:
    """Scaled to fit a square, in its middle, black around."""
    h, w = picture.shape[:2]
    scale = min(size / w, size / h)
    nw, nh = int(w * scale), int(h * scale)
    out = np.zeros((size, size, picture.shape[2]))
    top, left = (size - nh) // 2, (size - nw) // 2
    out[top : top + nh, left : left + nw] = resize(picture, nh, nw)
    return out


def centre_crop(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """The middle; black is added where the picture is smaller."""
    h, w = picture.shape[:2]
    pad_h, pad_w = max(0, height - h), max(0, width - w)
    p = picture
    if pad_h or pad_w:
        p = np.pad(picture, ((pad_h // 2, pad_h - pad_h // 2), (pad_w // 2, pad_w - pad_w // 2), (0, 0)))
    top, left = (p.shape[0] - height) // 2, (p.shape[1] - width) // 2
    return p[top : top + height, left : left + width]


def to_tensor(picture: np.ndarray, mean: Sequence[float] = (0, 0, 0), std: Sequence[float] = (1, 1, 1),
    scale: float = 1 / 255) -> np.ndarray:
    """Rescaled, normalised and turned to (C, H, W), single precision."""
    return ((picture * scale - np.asarray(mean)) / np.asarray(std)).transpose(2, 0, 1).astype(np.float32)
