"""Texts before text models: ids, cut or refused at a model's limit, padded to a batch's longest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from vecmill.errors import InvalidArgument


@dataclass(frozen=True)
class Batch:
    ids: np.ndarray
    mask: np.ndarray


def encode(tokenizer, texts: Sequence[str], most: int, preprocess: bool = True, pad_id: int = 0) -> Batch:
    """``preprocess`` cuts texts of more than ``most`` tokens; without it they are refused.

    ``tokenizer``: of the ``tokenizers`` library; its special tokens are added.
    """
    rows = [e.ids for e in tokenizer.encode_batch(list(texts), add_special_tokens=True)]
    longest = max(map(len, rows), default=0)
    if longest > most and not preprocess:
        raise InvalidArgument(f"a text of {longest} tokens, where {most} are taken")
    rows = [r[:most] for r in rows]
    width = max(map(len, rows), default=0)
    ids, mask = np.full((len(rows), width), pad_id, np.int64), np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        ids[i, : len(r)], mask[i, : len(r)] = r, 1
    return Batch(ids, mask)
