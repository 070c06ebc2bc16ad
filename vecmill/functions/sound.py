"""Sound before audio models: mono, resampled, repeated to length, log-mel spectrograms."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values of the audio model's front end.
RATE = 48_000
SECONDS = 10
WINDOW = 1024
HOP = 480
BANDS = 64
LOWEST = 50.0
HIGHEST = 14_000.0


def mono(samples: np.ndarray) -> np.ndarray:
    """Mean of the channels (last axis)."""
    return samples if samples.ndim == 1 else samples.mean(-1)


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation."""
    if rate == to or not len(samples):
        return samples
    n = int(round(len(samples) * to / rate))
    return np.interp(np.arange(n) * (rate / to), np.arange(len(samples)), samples)


def repeat_to(samples: np.ndarray, length: int) -> np.ndarray:
    """As many whole repeats as fit, then silence. Longer sounds are refused."""
    if len(samples) > length or not len(samples):
        raise ValueError(f"a sound of {len(samples)} samples, where 1 to {length} are taken")
    out = np.zeros(length, samples.dtype)
    whole = length // len(samples) * len(samples)
    out[:whole] = np.tile(samples, length // len(samples))
    return out


def mel(hz):
    return 2595 * np.log10(1 + np.asarray(hz, float) / 700)


def hertz(mels):
    return 700 * (10 ** (np.asarray(mels, float) / 2595) - 1)


@lru_cache(maxsize=4)
def mel_filters(bands: int = BANDS, bins: int = WINDOW // 2 + 1, low: float = LOWEST, high: float = HIGHEST,
    rate: int = RATE) -> np.ndarray:
    """(bands, bins): triangles between neighbouring points evenly spaced in mel, each with area of about 1 in hertz."""
    edges = hertz(np.linspace(mel(low), mel(high), bands + 2))
    points = np.minimum(np.round(edges / rate * 2 * (bins - 1)).astype(int), bins - 1)
    k = np.arange(bins)
    rows = []
    for left, mid, right, width in zip(points, points[1:], points[2:], edges[2:] - edges[:-2], strict=False):
        row = np.zeros(bins)
        up, down = (k >= left) & (k < mid), (k >= mid) & (k < right)
        row[up] = (k[up] - left) / (mid - left)
        row[down] = (right - k[down]) / (right - mid)
        row[mid] = 1
        rows.append(row * 2 / width)
    return np.array(rows)


def log_mel(samples: np.ndarray, frames: int = RATE * SECONDS // HOP) -> np.ndarray:
    """(frames, bands) in decibels, from Hann windows ``HOP`` samples apart; zeros where no whole window is left."""
    out = np.zeros((frames, BANDS))
    if len(samples) >= WINDOW:
        hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW))
        cut = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP][:frames]
        power = np.abs(np.fft.rfft(cut * hann, axis=1)) ** 2
        out[: len(cut)] = 10 * np.log10(np.maximum(power @ mel_filters().T, 1e-10))
    return out


def features(samples: np.ndarray, rate: int) -> np.ndarray:
    """What the model reads: (1, frames, bands), single precision."""
    ready = repeat_to(resample(mono(np.asarray(samples, float)), rate), RATE * SECONDS)
    return log_mel(ready)[None].astype(np.float32)
