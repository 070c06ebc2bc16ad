"""What stands before a model: raw inputs made into what its network reads.

A front end is given for a model beside its loader, is made once in a worker
process, and sees the same batches as the model. With ``preprocess`` it brings
any input into shape; without, inputs must have the model's shape already and
others are refused.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Any, Protocol

import numpy as np

from vecmill.errors import InvalidArgument
from vecmill.functions import sound, tokens, vision


class Front(Protocol):
    def __call__(self, inputs: Sequence[str | bytes], preprocess: bool) -> Any:
        """What the model's embedder is called with in place of the inputs."""


@lru_cache(maxsize=8)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass(frozen=True)
class TextFront:
    """Ids and mask, padded to the batch's longest; texts of more than ``max_tokens`` are cut, or refused without preprocessing."""

    tokenizer: str
    max_tokens: int
    pad_id: int = 0

    def __call__(self, inputs: Sequence[str], preprocess: bool) -> tokens.Batch:
        return tokens.encode(_tokenizer(self.tokenizer), inputs, self.max_tokens, preprocess, self.pad_id)


def decode_picture(data: bytes) -> np.ndarray:
    """(H, W, 3) of a binary PPM, or of whatever the imaging library reads where that is installed."""
    if data[:2] == b"P6":
        head, at = [], 2
        while len(head) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            head.append(int(data[at:end]))
            at = end
        width, height, most = head
        body = data[at + 1 : at + 1 + width * height * 3]
        if most != 255 or len(body) != width * height * 3:
            raise InvalidArgument("a picture that cannot be read")
        return np.frombuffer(body, np.uint8).reshape(height, width, 3).astype(np.float64)
    try:
        from PIL import Image
    except ImportError:
        raise InvalidArgument("pictures other than binary PPM need an imaging library") from None
    try:
        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"), np.float64)
    except OSError as e:
        raise InvalidArgument("a picture that cannot be read") from e


@dataclass(frozen=True)
class ImageFront:
    """(N, 3, size, size): scaled so that the shorter side fits and cut to the middle, or fitted whole into a black square; normalised."""

    size: int
    mean: tuple[float, ...] = (0.485, 0.456, 0.406)
    std: tuple[float, ...] = (0.229, 0.224, 0.225)
    scale: float = 1 / 255
    boxed: bool = False
    decode: Callable[[bytes], np.ndarray] = decode_picture

    def __call__(self, inputs: Sequence[bytes], preprocess: bool) -> np.ndarray:
        return np.stack([self._one(self.decode(x), preprocess) for x in inputs]) if len(inputs) else np.zeros((0, 3, self.size,
            self.size), np.float32)

    def _one(self, picture: np.ndarray, preprocess: bool) -> np.ndarray:
        h, w = picture.shape[:2]
        if not preprocess:
            if (h, w) != (self.size, self.size):
                raise InvalidArgument(f"a picture of {w} x {h}, where {self.size} x {self.size} is taken")
            return vision.to_tensor(picture, (0, 0, 0), (1, 1, 1), 1.0)
        if self.boxed:
            picture = vision.letterbox(picture, self.size)
        else:
            by = self.size / min(h, w)
            picture = vision.resize(picture, max(self.size, round(h * by)), max(self.size, round(w * by)))
            picture = vision.centre_crop(picture, self.size, self.size)
        return vision.to_tensor(picture, self.mean, self.std, self.scale)


def decode_wave(data: bytes) -> tuple[np.ndarray, int]:
    """(samples from -1 to 1, by channel; rate) of a WAVE file of 8, 16 or 32 bits."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[f.getsampwidth()]
            x = np.frombuffer(f.readframes(f.getnframes()), kind).astype(np.float64).reshape(-1, f.getnchannels())
            if f.getsampwidth() == 1:
                x -= 128
            return x / (1 << (8 * f.getsampwidth() - 1)), f.getframerate()
    except (wave.Error, EOFError, KeyError) as e:
        raise InvalidArgument("a sound that cannot be read") from e


@dataclass(frozen=True)
class SoundFront:
    """(N, 1, frames, bands) of log-mel spectrograms; without preprocessing sounds must be mono, of the model's rate and length."""

    decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_wave

    def __call__(self, inputs: Sequence[bytes], preprocess: bool) -> np.ndarray:
        out = []
        for data in inputs:
            samples, rate = self.decode(data)
            if not preprocess and (rate, samples.size, len(samples)) != (sound.RATE, sound.RATE * sound.SECONDS,
                sound.RATE * sound.SECONDS):
                raise InvalidArgument(f"a sound of {len(samples)} samples at {rate}, where {sound.RATE * sound.SECONDS} at {sound.RATE} are taken")
            try:
                out.append(sound.features(samples, rate))
            except ValueError as e:
                raise InvalidArgument(str(e)) from e
        return np.stack(out)
