"""Models that turn raw inputs into vectors.

Weights are not part of this engine: an ``Embedder`` is given for each model
name, and a front end (``embedding.front``) for those that read token ids,
pixels or spectrograms. Both are loaded once in a worker process and see a
batch of inputs at a time; models that are idle are dropped. ``MODELS``
describes the known models: what they read, how long their vectors are and the
parameters they take.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.embedding.front import Front
from vecmill.errors import InvalidArgument
from vecmill.types import META, VALUE, Meta

#: One vector made from an input, with what the model says about it.
Found = tuple[Sequence[float], dict[str, str]]


class Embedder(Protocol):
    def __call__(self, inputs: Sequence[str | bytes], params: dict[str, str]) -> list[list[Found]]:
        """For each input (or what the model's front end makes of them) its vectors: one, or none to many for models that find parts."""


@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str  # of input: str, img, aud
    dimension: int
    batch: int
    max_tokens: int | None = None
    image_size: int | None = None
    one_to_many: bool = False
    needs_preprocessing: bool = False
    #: Thresholds that a caller may set, from 0 to 1, with their defaults.
    thresholds: tuple[tuple[str, float], ...] = ()
    #: Thresholds that no caller can change.
    fixed: tuple[tuple[str, float], ...] = ()
    #: What may be asked for under ``attributes``, separated by commas.
    attributes: tuple[str, ...] = ()

    def parameters(self, given: dict[str, str] | None) -> dict[str, str]:
        """``given`` with the model's defaults; a threshold that is no number gives way to its default."""
        out = dict(given or {})
        for name, default in self.thresholds:
            try:
                value = float(out.get(name, default))
            except ValueError:
                value = default
            out[name] = repr(value)
        out |= {name: repr(value) for name, value in self.fixed}
        if "attributes" in out:
            out["attributes"] = ",".join(a for a in map(str.strip, out["attributes"].split(",")) if a in self.attributes)
        return out


#: Names, inputs and vector lengths of the known models.
MODELS = {
    m.name: m
    for m in (
        ModelSpec("all-minilm-l6-v2", "str", 384, 128, 256),
        ModelSpec("all-minilm-l12-v2", "str", 384, 128, 256),
        ModelSpec("bge-base-en-v1.5", "str", 768, 128, 512),
        ModelSpec("bge-large-en-v1.5", "str", 1024, 128, 512),
        ModelSpec("resnet-50", "img", 2048, 16, image_size=224),
        ModelSpec("clip-vit-b32-image", "img", 512, 16, image_size=224),
        ModelSpec("clip-vit-b32-text", "str", 512, 128, 77),
        ModelSpec("sface-yunet", "img", 128, 16, image_size=640, one_to_many=True, needs_preprocessing=True,
            thresholds=(("confidence_threshold", 0.6),), fixed=(("nms_threshold", 0.4),)),
        ModelSpec(
            "buffalo-l", "img", 512, 16, image_size=640, one_to_many=True, needs_preprocessing=True,
                thresholds=(("confidence_threshold", 0.5), ("nms_threshold", 0.4)), attributes=("genderage",)
        ),
        ModelSpec("clap-audio", "aud", 512, 8),
        ModelSpec("clap-text", "str", 512, 128, 512),
        ModelSpec("jina-embeddings-v2-base-code", "str", 768, 128, 8192),
    )
}

EMBEDDED = f"pos long, input {META.simpleString()}, number int, key array<float>, value {VALUE.simpleString()}"


@dataclass(frozen=True)
class HashEmbedder:
    """A stand-in without weights: a unit vector that depends on the input alone. For tests."""

    dimension: int

    def __call__(self, inputs: Sequence[str | bytes], params: dict[str, str]) -> list[list[Found]]:
        out = []
        for x in inputs:
            seed = hashlib.sha256(x.encode() if isinstance(x, str) else x).digest()
            v = np.random.default_rng(list(seed[:16])).normal(size=self.dimension)
            out.append([((v / np.linalg.norm(v)).astype(np.float32).tolist(), {})])
        return out


@dataclass
class Registry:
    """Embedders and front ends by model name; a loader is called once in each worker process.

    A model that was not used for ``idle_seconds`` is dropped when another one is asked for.
    """

    loaders: dict[str, Callable[[], Embedder]]
    specs: dict[str, ModelSpec] = None
    fronts: dict[str, Callable[[], Front]] = None
    idle_seconds: float = 300.0

    def __post_init__(self):
        self.specs = dict(MODELS) | (self.specs or {})
        self.fronts = self.fronts or {}

    def _load(self, model: str) -> Callable[[], Callable]:
        return _pair(self.loaders[model], self.fronts.get(model))

    def spec(self, model: str) -> ModelSpec:
        if model not in self.specs or model not in self.loaders:
            raise InvalidArgument(f"model {model} is not loaded")
        return self.specs[model]

    def check(self, model: str, inputs: Sequence[Meta], preprocess: bool) -> ModelSpec:
        spec = self.spec(model)
        if spec.needs_preprocessing and not preprocess:
            raise InvalidArgument(f"model {model} cannot go without preprocessing")
        for x in inputs:
            if x.kind != spec.kind:
                raise InvalidArgument(f"model {model} reads {spec.kind}, not {x.kind}")
        return spec

    def embed(self, model: str, inputs: Sequence[Meta], preprocess: bool = True, params: dict[str, str] | None = None) -> list[list[Found]]:
        """On the driver, for the few inputs of a query."""
        spec = self.check(model, inputs, preprocess)
        return _loaded(model, self._load(model), self.idle_seconds)([x.data for x in inputs], preprocess, spec.parameters(params))

    def embed_frame(self, given: DataFrame, model: str, preprocess: bool = True, params: dict[str, str] | None = None) -> DataFrame:
        """(pos, input, number, key, value) of inputs (pos, input, value), a batch at a time in the workers.

        An input that gives several vectors gives as many rows, its value and
        what the model says about each put together; one that gives none, none.
        """
        spec = self.check(model, [], preprocess)
        wrong = given.where(F.col("input.kind") != spec.kind).limit(1).count()
        if wrong:
            raise InvalidArgument(f"model {model} reads {spec.kind} alone")
        load, kwargs, idle = self._load(model), spec.parameters(params), self.idle_seconds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = _loaded(model, load, idle)
            for b in batches:
                kinds, texts, bins = (c.to_pylist() for c in b.column("input").flatten())
                data = [s if k == "str" else x for k, s, x in zip(kinds, texts, bins, strict=True)]
                at, numbers, keys, said, held = [], [], [], [], 0
                for start in range(0, len(data), spec.batch):
                    part = data[start : start + spec.batch]
                    for i, found in enumerate(net(part, preprocess, kwargs), start):
                        at += [i] * len(found)
                        numbers += range(len(found))
                        keys += [[float(x) for x in key] for key, _ in found]
                        said += [s for _, s in found]
                        held += len(found) * len(data[i])
                    if len(at) >= OUT_ROWS or held >= OUT_BYTES:
                        yield _made(b, at, numbers, keys, said)
                        at, numbers, keys, said, held = [], [], [], [], 0
                if at:
                    yield _made(b, at, numbers, keys, said)

        return given.select(F.col("pos").cast("long").alias("pos"), "input", F.col("value").cast(VALUE).alias("value")).mapInArrow(run, EMBEDDED)


OUT_ROWS, OUT_BYTES = 4096, 4 << 20  # rows, and bytes of inputs, after which what was made leaves a worker


def _made(b: pa.RecordBatch, at: list[int], numbers: list[int], keys: list[list[float]], said: list[dict[str, str]]) -> pa.RecordBatch:
    taken = b.take(pa.array(at, pa.int64()))
    value = taken.column("value")
    if any(said) or value.null_count:
        extra = [{k: {"kind": "str", "str": v, "bin": None} for k, v in s.items()} for s in said]
        value = pa.array([list((dict(m or ()) | x).items()) for m, x in zip(value.to_pylist(), extra, strict=True)], value.type)
    return pa.RecordBatch.from_arrays([taken.column("pos"), taken.column("input"), pa.array(numbers, pa.int32()),
        pa.array(keys, pa.list_(pa.float32())), value], ["pos", "input", "number", "key", "value"])


def _pair(load: Callable[[], Embedder], front: Callable[[], Front] | None) -> Callable[[], Callable]:
    """A loader of both, whose result takes (inputs, preprocess, params)."""

    def loader() -> Callable:
        net = load()
        if front is None:
            return lambda inputs, preprocess, params: net(inputs, params)
        ready = front()
        return lambda inputs, preprocess, params: net(ready(inputs, preprocess), params)

    return loader


_MODELS: dict[str, tuple[Callable, float]] = {}


def _loaded(model: str, load: Callable[[], Callable], idle: float) -> Callable:
    now = time.monotonic()
    for name in [n for n, (_, used) in _MODELS.items() if n != model and now - used > idle]:
        del _MODELS[name]
    net = _MODELS[model][0] if model in _MODELS else load()
    _MODELS[model] = net, now
    return net
