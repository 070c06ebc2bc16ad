"""Toxicity by subword-bag embeddings and a linear softmax (operator 5).

A word is the mean of the embeddings of its character n-grams, a window of
words the mean of its words, and a linear softmax over two classes judges the
window; embeddings and softmax are trained jointly in numpy. A document is as
toxic as its most toxic window, so one slur counts in a text of any length;
training picks each document's window by the model so far. Unseen spellings
share n-grams with seen ones. As everything before the softmax is a mean,
scoring needs one number for each word: its share of the logit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.common import first_by_hash, in_batches

BUCKETS = 1 << 16
SIZES = (3, 4, 5, 6)
WIDTH = 3  # words in a window
EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»“”‘’…¡¿"


def word_grams(words: list[str], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, begins): the n-gram buckets of each word one after another; every word has at least one."""
    found, counts = [], []
    for at in range(0, len(words), part):
        b, n = _word_grams(words[at : at + part])
        found.append(b)
        counts.append(n)
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))])[:-1]


def _word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how many of each word)."""
    raw = [b"<" + w.strip(EDGES).encode("utf-8", "replace") + b">" for w in words]
    length = np.array([len(r) for r in raw], np.int64)
    begins = np.concatenate([[0], np.cumsum(length)])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    ends = np.repeat(begins[1:], length)
    owner = np.repeat(np.arange(len(raw)), length)
    at = np.arange(len(data))
    buckets, owners = [], []
    h = np.zeros(len(data), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(SIZES) + 1):
            shifted = np.zeros(len(data), np.uint64)
            if len(data) >= n:
                shifted[: len(data) - n + 1] = data[n - 1 :]
            h = (h * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)) ^ (h >> np.uint64(29))
            if n in SIZES or n == 2:  # words of no more than a letter have only the shortest
                good = (at + n <= ends) & ((n != 2) | (ends - begins[owner] < min(SIZES)))
                buckets.append(((h[good] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int32) % BUCKETS)
                owners.append(owner[good])
    owner_all = np.concatenate(owners)
    order = np.argsort(owner_all, kind="stable")
    counts = np.bincount(owner_all, minlength=len(raw))
    return np.concatenate(buckets)[order], counts


def _means(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Means of runs of values."""
    sizes = np.diff(np.append(begins, len(values)))
    return np.add.reduceat(values, begins) / sizes if len(begins) else np.zeros(0)


def window_means(scores: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Mean of every run of ``width`` words (of all, if fewer)."""
    return _window_means(scores, np.array([0, len(scores)]), width)[0]


def _window_means(scores: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The means of each text's windows one after another, and where each text's begin; texts lie between ``ends`` and hold a word at least."""
    begins, sizes = ends[:-1], np.diff(ends)
    counts = np.maximum(1, sizes - width + 1)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(begins - firsts[:-1], counts) + np.arange(firsts[-1])
    held = np.repeat(np.minimum(sizes, width), counts)
    padded, total = np.concatenate([scores, np.zeros(width)]), np.zeros(len(at))
    for i in range(width):
        total += np.where(i < held, padded[at + i], 0.0)
    return total / held, firsts[:-1]


def _first_largest(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each run of values the place, from 0, of its largest one, the first of equals."""
    sizes = np.diff(np.append(begins, len(values)))
    at = np.flatnonzero(values == np.repeat(np.maximum.reduceat(values, begins), sizes))
    owner = np.repeat(np.arange(len(begins)), sizes)[at]
    _, first = np.unique(owner, return_index=True)
    return at[first] - begins


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words of all texts, how many each has): lower case, cut at white space; null texts have none."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    owner, words = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy()), split.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real).dictionary_encode(), np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


@dataclass
class SubwordBag:
    """``shares``: for each bucket, its embedding times (toxic - clean) softmax weights. Remembers up to ``limit`` words of up to ``longest`` characters."""

    shares: np.ndarray
    bias: float
    limit: int = 200_000
    longest: int = 40
    known: tuple[pa.Array, np.ndarray] | None = field(default=None, repr=False)

    def of_words(self, words: pa.Array) -> np.ndarray:
        """The share in the logit of each of these distinct words."""
        words = words.cast(pa.string())
        held, scores = self.known or (pa.array([], pa.string()), np.zeros(0))
        at = pc.index_in(words, value_set=held)
        fresh = np.asarray(at.is_null())
        out = np.zeros(len(words))
        out[~fresh] = scores[at.drop_null().to_numpy()]
        if fresh.any():
            new = words.filter(pa.array(fresh))
            buckets, begins = word_grams(new.to_pylist())
            out[fresh] = _means(self.shares[buckets], begins)
            short = pc.utf8_length(new).to_numpy() <= self.longest
            if len(held) + short.sum() > self.limit:
                held, scores, short = held[:0], scores[:0], short & (np.cumsum(short) <= self.limit)
            self.known = pa.concat_arrays([held, new.filter(pa.array(short))]), np.concatenate([scores, out[fresh][short]])
        return out

    def score(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        """Probability that each text is toxic."""
        words, sizes = words_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        p, some = np.zeros(len(sizes)), sizes > 0
        if some.any():
            scores = self.of_words(words.dictionary)[words.indices.to_numpy()]
            means, begins = _window_means(scores, np.concatenate([[0], np.cumsum(sizes[some])]))
            p[some] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(means, begins) + self.bias, -50, 50)))
        return p

    def __getstate__(self):
        return self.__dict__ | {"known": None}


def train(texts: list[str], toxic: list[int], dim: int = 8, warm: int = 40, steps: int = 160, rate: float = 0.05,
    seed: int = 3) -> SubwordBag:
    """Joint training by Adam over the whole sample; a model that calls all clean if a class is missing."""
    words, counts = words_of(pa.array(texts, pa.string()))
    y = np.array([v for v, n in zip(toxic, counts, strict=True) if n], np.float64)
    if not len(y) or y.min() == y.max():
        return SubwordBag(np.zeros(BUCKETS, np.float64), 10.0 if len(y) and y.min() == 1 else -10.0)
    vocab = words.dictionary.to_pylist()
    buckets, begins = word_grams(vocab)
    sizes = np.diff(np.append(begins, len(buckets)))
    # grams are many, so they are gone through a part at a time
    parts = [(i, min(len(vocab), i + 8192)) for i in range(0, len(vocab), 8192)]
    ends = np.append(begins, len(buckets))
    flat, starts = words.indices.to_numpy().astype(np.int32), np.concatenate([[0], np.cumsum(counts[counts > 0])])
    del words, texts
    rng = np.random.default_rng(seed)
    emb, soft, bias = rng.normal(size=(BUCKETS, dim)) * 0.1, rng.normal(size=(2, dim)) * 0.1, np.zeros(2)
    params = [emb, soft, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    spans = np.stack([starts[:-1], starts[1:]], 1)

    def logits() -> np.ndarray:
        shares, own = emb @ (soft[1] - soft[0]), np.empty(len(vocab))
        for i, j in parts:
            own[i:j] = _means(shares[buckets[ends[i] : ends[j]]], begins[i:j] - begins[i])
        return own[flat]

    def by_bucket(per_word: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for i, j in parts:
            out += np.bincount(buckets[ends[i] : ends[j]], np.repeat(per_word[i:j], sizes[i:j]), BUCKETS)
        return out

    for step in range(1, warm + steps + 1):
        words = logits()
        if step > warm and step % 2:  # each document's most toxic window so far
            means, firsts = _window_means(words, starts)
            best = _first_largest(means, firsts)
            begins_at = starts[:-1] + best
            spans = np.stack([begins_at, np.minimum(starts[1:], begins_at + WIDTH)], 1)
        n = spans[:, 1] - spans[:, 0]
        pos = np.repeat((spans[:, 0] - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        z = np.bincount(doc, words[pos], len(n)) / n + bias[1] - bias[0]
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        d = (p - y) * weight
        per_word = np.bincount(flat[pos], (d / n)[doc], len(vocab)) / sizes
        per_bucket = by_bucket(per_word)
        lean = per_bucket @ emb
        grads = [np.outer(per_bucket, soft[1] - soft[0]) + 1e-6 * emb, np.stack([-lean, lean]), np.array([-d.sum(), d.sum()])]
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    words = logits()
    top = np.maximum.reduceat(*_window_means(words, starts))
    return SubwordBag(emb @ (soft[1] - soft[0]), -_cut(top, y))


def _cut(top: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the fewest errors, halfway between the scores beside it."""
    order = np.argsort(top)
    s, t = top[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    return float((s[max(k - 1, 0)] + s[min(k, len(s) - 1)]) / 2)


def learning_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, held: int, most: int,
    longest: int) -> tuple[list[str], list[int]]:
    """At most ``most`` labelled documents of either class, the first by a hash of the id, of at most ``longest`` characters."""
    named = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) != held)
    )
    picked, counts = None, {r["toxic"]: r["count"] for r in named.groupBy("toxic").count().collect()}
    for label in (0, 1):
        part = first_by_hash(named.where(F.col("toxic") == label), "id", most, counts.get(label, 0))
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= longest)
    got = texts.join(F.broadcast(picked), "id").select("id", "text", "toxic").collect()  # 2 * most rows at most are broadcast
    got.sort(key=lambda r: (r["id"], r["text"], r["toxic"]))
    return [r["text"] for r in got], [r["toxic"] for r in got]


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = 0,
    train_docs: int = 2000, train_chars: int = 6_000, extra: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """(id, held_out, score, predicted, *extra) for every row; labels join by the same id.

    ``keep_text`` hands the texts on as ``_vm_text``.

    Learns from at most ``train_docs`` documents of either class, of at most
    ``train_chars`` characters, never from rows whose crc32(id) mod 5 is
    ``held``; every whole text is scored. Null and empty texts score 0. With no
    labels, or one class only, all texts get the known class (clean if none).
    Repeated rows stay; repeated labels weigh more; an empty table gives an
    empty result.
    """
    given = docs.sparkSession.sparkContext.broadcast(train(*learning_sample(docs, labels, id_col, text_col, held, train_docs, train_chars)))
    slim = docs.select(
        F.col(id_col).alias("_vm_id"), F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == held,
            F.lit(False)).alias("_vm_held"), *extra, F.col(text_col).cast("string").alias("_vm_text")
    )

    passed = (*extra, *["_vm_text"] * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("_vm_id", "_vm_held", *passed)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(given.value.score(batch.column("_vm_text")), pa.float64())],
                ["_vm_id", "_vm_held", *passed, "_vm_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if keep_text or f.name != "_vm_text")
    out = in_batches(slim, run, f"{kinds}, _vm_score double")
    score = F.col("_vm_score")
    return out.select(F.col("_vm_id").alias(id_col), F.col("_vm_held").alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"), *passed)
