"""Spectral features of waveforms: two log-mel variants and the filter-bank features of speech recognisers.

FFTs have no Spark expression, so these are Arrow UDFs over numpy; windows and filter banks are made once per worker.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

_FRAMES = ArrayType(ArrayType(FloatType()))


def _slaney_mel(hz: np.ndarray) -> np.ndarray:
    """Linear below 1 kHz (200/3 Hz a mel), logarithmic above (27 mels a factor of 6.4)."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1000) / 1000) * 27 / np.log(6.4))


def _slaney_hz(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=16)
def mel_bank(rate: int, n_fft: int, bands: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """(bands, n_fft // 2 + 1) triangles on the Slaney scale, each of area 1 in Hz."""
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    edges = _slaney_hz(np.linspace(_slaney_mel(low), _slaney_mel(high or rate / 2), bands + 2))
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    shape = np.maximum(0, np.minimum((bins - left) / (mid - left), (right - bins) / (right - mid)))
    return shape * 2 / (right - left)


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


@lru_cache(maxsize=16)
def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _reflected(x: np.ndarray, pad: int) -> np.ndarray:
    return np.pad(x, pad, mode="reflect") if len(x) > 1 else np.pad(x, pad)


def log_mel(x: np.ndarray, rate: int = 22_050, n_fft: int = 1024, hop: int = 256, bands: int = 80, centred: bool = True, least: float = 1e-5) -> np.ndarray:
    """(frames, bands) log magnitudes. ``centred`` frames sit on their sample; otherwise the signal is padded by (n_fft - hop) / 2
    at either end and the magnitude is softened by 1e-9."""
    x = np.asarray(x, float)
    if not len(x):
        return np.zeros((0, bands))
    padded = _reflected(x, n_fft // 2 if centred else (n_fft - hop) // 2)
    spectrum = np.fft.rfft(_frames(padded, n_fft, hop) * _hann(n_fft))
    magnitude = np.abs(spectrum) if centred else np.sqrt(np.abs(spectrum) ** 2 + 1e-9)
    return np.log(np.maximum(magnitude @ mel_bank(rate, n_fft, bands).T, least))


@lru_cache(maxsize=16)
def _speech_bank(rate: int, n_fft: int, bands: int, low: float = 20.0) -> np.ndarray:
    """Triangles that are even in mel = 1127 ln(1 + f / 700), without the Nyquist bin."""

    def mel(f):
        return 1127 * np.log1p(np.asarray(f, float) / 700)

    edges = np.linspace(mel(low), mel(rate / 2), bands + 2)
    at = mel(np.arange(n_fft // 2) * rate / n_fft)
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((at - left) / (mid - left), (right - at) / (right - mid)))


def speech_fbank(x: np.ndarray, rate: int = 16_000, bands: int = 80, length_ms: float = 25.0, shift_ms: float = 10.0) -> np.ndarray:
    """(frames, bands) log power features, without dither, each band's mean over time taken off.

    Per frame: mean removed, pre-emphasis 0.97, the 0.85th power of a Hann window, FFT of the next power of two.
    """
    size, hop = int(rate * length_ms / 1000), int(rate * shift_ms / 1000)
    frames = _frames(np.asarray(x, float), size, hop)
    if not len(frames):
        return np.zeros((0, bands))
    frames = frames - frames.mean(axis=1, keepdims=True)
    frames = frames - 0.97 * np.concatenate([frames[:, :1], frames[:, :-1]], axis=1)
    window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))) ** 0.85
    n_fft = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames * window, n_fft)[:, :-1]) ** 2
    features = np.log(np.maximum(power @ _speech_bank(rate, n_fft, bands).T, np.finfo(np.float32).eps))
    return features - features.mean(axis=0)


def _udf(f, **options):
    @F.pandas_udf(_FRAMES)
    def features(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: None if x is None else [row.astype(np.float32) for row in f(x, **options)])

    return features


def log_mel_udf(**options):
    return _udf(log_mel, **options)


def speech_fbank_udf(**options):
    return _udf(speech_fbank, **options)
