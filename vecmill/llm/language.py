"""Language ID by a bidirectional gated recurrent network over bytes (operator 7).

Trained in numpy by backpropagation through time on windows of bytes, with a
label at every position. A text is read whole, in windows, in both directions;
a document's probabilities are the mean over its letters' positions. Arrays are
laid out (units, windows), so every gate is one contiguous block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecmill.llm.common import in_batches

SPAN = 64
#: More languages than these are refused, never left out.
MOST_LANGUAGES = 512


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category (L*): fractions, Roman numerals, digits and signs are none."""
    return any(map(str.isalpha, text))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def letter_bytes(text: str) -> tuple[bytes, np.ndarray]:
    """The text in UTF-8, and which of its bytes belong to letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    return text.encode("utf-8", "replace"), np.repeat(_letters()[codes], sizes)


@dataclass
class ByteTagger:
    """Gates: r, z = (1 + tanh(.)) / 2; n = tanh(x + r * q); h' = n + z * (h - n)."""

    labels: list[str]
    inputs: np.ndarray  # (2, 3H, 256)
    hidden: np.ndarray  # (2, 3H, H)
    out: np.ndarray  # (labels, 2H)
    bias: np.ndarray  # (labels, 1)

    @classmethod
    def fresh(cls, labels: list[str], units: int, seed: int) -> ByteTagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
        return cls(labels, draw(2, 3 * units, 256, by=0.3), draw(2, 3 * units, units, by=units**-0.5),
            draw(len(labels), 2 * units, by=0.1), np.zeros((len(labels), 1), np.float32))

    def _direction(self, d: int, x: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States (T, H, N) in reading order of direction d over the bytes x (T, N)."""
        steps, n = x.shape
        units = self.hidden.shape[2]
        a, g, h = np.empty((3 * units, n), np.float32), np.empty((3 * units, n), np.float32), np.zeros((units, n), np.float32)
        states = np.empty((steps, units, n), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(self.inputs[d], x[t], 1, out=a, mode="clip")
            np.matmul(self.hidden[d], h, out=g)
            gates = a[: 2 * units]
            gates += g[: 2 * units]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = a[2 * units :]
            new += gates[:units] * g[2 * units :]
            np.tanh(new, out=new)
            if kept is not None:
                kept.append((t, h.copy(), gates.copy(), new.copy(), g[2 * units :].copy()))
            h -= new
            h *= gates[units:]
            h += new
            states[t] = h
        return states

    def _softmax(self, states: list[np.ndarray]) -> np.ndarray:
        units = self.hidden.shape[2]
        o = np.matmul(self.out[:, :units], states[0]) + np.matmul(self.out[:, units:], states[1]) + self.bias
        o -= o.max(1, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(1, keepdims=True)
        return o

    def tag(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, labels, N) of every position of the bytes x (T, N)."""
        return self._softmax([self._direction(0, x), self._direction(1, x)])

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of all parameters, by backpropagation through time."""
        units, (steps, n) = self.hidden.shape[2], x.shape
        kept: list[list] = [[], []]
        states = [self._direction(d, x, kept[d]) for d in (0, 1)]
        p = self._softmax(states)
        picked = p[:, y, np.arange(n)]
        total = weight.sum()
        loss = float((-np.log(picked + 1e-9) * weight).sum() / total)
        p[:, y, np.arange(n)] -= 1
        p *= (weight / total)[:, None, :]
        g_out = np.concatenate([np.einsum("tln,thn->lh", p, s, optimize=True) for s in states], 1)
        g_inputs, g_hidden = np.zeros_like(self.inputs), np.zeros_like(self.hidden)
        for d in (0, 1):
            into = np.matmul(self.out[:, d * units : (d + 1) * units].T, p)  # (T, H, N)
            dh, per_input = np.zeros((units, n), np.float32), np.empty((steps, 3 * units, n), np.float32)
            for t, before, gates, new, q in reversed(kept[d]):
                dh += into[t]
                r, z = gates[:units], gates[units:]
                d_new = dh * (1 - z) * (1 - new * new)
                pre = per_input[t]
                pre[:units] = 2 * d_new * q * r * (1 - r)
                pre[units : 2 * units] = 2 * dh * (before - new) * z * (1 - z)
                pre[2 * units :] = d_new
                back = np.concatenate([pre[: 2 * units], d_new * r])
                g_hidden[d] += back @ before.T
                dh = dh * z + self.hidden[d].T @ back
            flat = per_input.transpose(1, 0, 2).reshape(3 * units, -1)
            index = x.reshape(-1)
            for k in range(3 * units):
                g_inputs[d, k] = np.bincount(index, flat[k], 256)
        return loss, [g_inputs, g_hidden, g_out, p.sum((0, 2))[:, None]]


def windows_of(text: str, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(T, N) bytes, and which are of letters; zeros after the end."""
    data, letters = letter_bytes(text)
    n = -(-len(data) // span)
    x, own = np.zeros(n * span, np.uint8), np.zeros(n * span, bool)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    own[: len(data)] = letters
    return x.reshape(n, span).T, own.reshape(n, span).T


def train(texts: list[str], langs: list[str], units: int = 16, steps: int = 500, batch: int = 256, rate: float = 0.01,
    seed: int = 5) -> ByteTagger | None:
    """Adam on windows drawn evenly from the languages. None without anything to learn from."""
    by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for text, lang in zip(texts, langs, strict=True):
        if text and has_letter(text):
            by.setdefault(lang, []).append(windows_of(text))
    if not by:
        return None
    labels = sorted(by)
    pools = [[np.concatenate(x, 1) for x in zip(*by[k], strict=True)] for k in labels]
    net, rng = ByteTagger.fresh(labels, units, seed), np.random.default_rng(seed)
    params = [net.inputs, net.hidden, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    each = max(1, batch // len(labels))
    for step in range(1, steps + 1):
        drawn = [(p, own, rng.integers(0, p.shape[1], each)) for p, own in pools]
        x = np.concatenate([p[:, at] for p, _, at in drawn], 1).astype(np.intp)
        weight = np.concatenate([own[:, at] for _, own, at in drawn], 1).astype(np.float32)
        weight[0, 0] += 1e-6
        _, grads = net.gradients(x, np.repeat(np.arange(len(labels)), each), weight)
        now = rate * min(1, 3 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def predict(net: ByteTagger | None, texts: list[str | None], width: int = 2048) -> list[tuple[str, float]]:
    """(language, probability) of each text; ``und`` and 0 for a text without a letter, or without a model."""
    sums = np.zeros((len(texts), len(net.labels) if net else 1))
    width = min(width, max(64, 2048 * 64 // sums.shape[1]))
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        x, letters = (np.concatenate(x, 1) for x in zip(*pending, strict=True))
        p = net.tag(x.astype(np.intp))
        p *= letters[:, None, :]
        pooled, at = p.sum(0, dtype=np.float64), 0
        for i, n in owners:
            sums[i] += pooled[:, at : at + n].sum(1)
            at += n
        pending.clear()
        owners.clear()

    have = 0
    for i, text in enumerate(texts):
        if net and text and has_letter(text):
            x, letters = windows_of(text)
            at = 0
            while at < x.shape[1]:
                part = slice(at, at + width - have)
                pending.append((x[:, part], letters[:, part]))
                n = pending[-1][0].shape[1]
                owners.append((i, n))
                have, at = have + n, at + n
                if have >= width:
                    flush()
                    have = 0
    if have:
        flush()
    out = []
    for s in sums:
        total = s.sum()
        out.append((net.labels[int(s.argmax())], float(s.max() / total)) if total > 0 else ("und", 0.0))
    return out


def learning_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held: int, most: int, spots: int = 8,
    chars: int = 128) -> tuple[list[str], list[str]]:
    """Pieces of at most ``most`` documents of each language, the first by a hash of the id, spread over their texts."""
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32("i"), F.lit(4)) != held))
    counts = rows.groupBy("lang").count()
    langs = counts.count()
    if langs > MOST_LANGUAGES:
        raise ValueError(f"{langs} languages to learn, more than {MOST_LANGUAGES}")
    most = min(most, max(1, 64 * most // max(1, langs)))  # what comes to the driver is bounded
    n = F.length("text")
    pieces = F.array_join(F.array(*[F.substring(F.col("text"), F.floor(n * (k / spots)).cast("int") + 1,
        F.lit(chars)) for k in range(spots)]), " ")
    h = F.pmod(F.xxhash64(F.col("i"), F.lit("share")), F.lit(1 << 31))
    # of a language about twice as many are cut out before they meet in one task
    cut = F.least(F.lit(1.0), F.lit(2.0 * most + 100) / F.col("count")) * F.lit(float(1 << 31))
    some = rows.join(F.broadcast(counts), "lang").where(h < cut.cast("long") + 1)
    named = some.select("lang", "i", h.alias("h"), F.when(n <= spots * chars, F.col("text")).otherwise(pieces).alias("piece"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "i"))
    taken = named.withColumn("nth", nth).where(F.col("nth") <= most)
    got = sorted(taken.select("lang", "nth", "piece").collect(), key=lambda r: (r["lang"], r["nth"]))
    return [r["piece"] for r in got], [r["lang"] for r in got]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = 2,
    train_docs: int = 400, extra: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """(id, held_out, lang_pred, score, languages, *extra) for every row; ``languages``: how many were learned; ``keep_text`` hands the texts on as ``_vm_text``.

    Learns every language, from at most ``train_docs`` documents of each (of more than 64
    languages 64 * ``train_docs`` in all, shared evenly; more than 512 are an error), never from
    rows whose crc32(id) mod 4 is ``held``; every whole text is predicted.
    Null texts and texts without a letter give ``und`` and 0; so does every
    text where there is nothing to learn from. A null id is not held out.
    Repeated rows stay; an empty table gives an empty result.
    """
    net = train(*learning_sample(docs, id_col, text_col, lang_col, held, train_docs))
    given = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    slim = docs.select(
        F.col(id_col).alias("_vm_id"), F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == held,
            F.lit(False)).alias("_vm_held"), *extra, F.col(text_col).cast("string").alias("_vm_text")
    )

    passed = (*extra, *["_vm_text"] * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                found = predict(given.value, b.column("_vm_text").to_pylist())
                cols = [b.column("_vm_id"), b.column("_vm_held"), *(b.column(c) for c in passed)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x for x, _ in found], pa.string()),
                    pa.array([x for _, x in found], pa.float64())], ["_vm_id", "_vm_held", *passed, "_vm_lang", "_vm_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if keep_text or f.name != "_vm_text")
    out = in_batches(slim, run, f"{kinds}, _vm_lang string, _vm_score double")
    return out.select(F.col("_vm_id").alias(id_col), F.col("_vm_held").alias("held_out"), F.col("_vm_lang").alias("lang_pred"),
        F.col("_vm_score").alias("score"), F.lit(len(net.labels) if net else 0).alias("languages"), *passed)
