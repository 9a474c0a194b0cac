"""Signal functions over whole waveforms of a song (array<float>, 16 kHz): high-pass and log spectrogram.

A song is one row or a few chunks; corpora are spread over songs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

RATE, N_FFT, HOP = 16000, 1024, 256


def highpassed(y: np.ndarray, cutoff: float = 80.0, rate: int = RATE) -> np.ndarray:
    """Zero-phase high-pass of magnitude 1 / (1 + (cutoff / f)^8)."""
    if len(y) < 2 or cutoff <= 0:
        return y.astype(np.float32)
    f = np.fft.rfftfreq(len(y), 1 / rate)
    gain = np.divide(1.0, 1 + np.divide(cutoff, f, out=np.full_like(f, np.inf), where=f > 0) ** 8)
    return np.fft.irfft(np.fft.rfft(y) * gain, len(y)).astype(np.float32)


@pandas_udf(ArrayType(FloatType()))
def highpass(y: pd.Series) -> pd.Series:
    return y.map(lambda x: None if x is None else highpassed(np.asarray(x, float)))


def log_spectrum(y: np.ndarray) -> np.ndarray:
    """(frames, 513) of log(1 + 1000 * |X|), periodic Hann window, scaled by the window's sum."""
    if len(y) < N_FFT:
        return np.empty((0, N_FFT // 2 + 1), np.float32)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    frames = np.lib.stride_tricks.sliding_window_view(y, N_FFT)[::HOP]
    return np.log1p(1000 * np.abs(np.fft.rfft(frames * window, axis=1) / window.sum()).astype(np.float32))


def spectrogram(songs: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """keys, t, f, value: a row per cell of each song's log spectrogram."""
    kinds = ", ".join(f"{c} {songs.schema[c].dataType.simpleString()}" for c in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                s = log_spectrum(np.asarray(row[samples] if row[samples] is not None else [], float))
                for a in range(0, len(s), 200):
                    part = s[a : a + 200]
                    out = {c: row[c] for c in keys} | {"t": np.repeat(np.arange(a, a + len(part)), part.shape[1]), "f": np.tile(np.arange(part.shape[1]), len(part)), "value": part.ravel()}
                    yield pd.DataFrame(out)

    return songs.select(*keys, samples).mapInPandas(run, f"{kinds}, t int, f int, value float")
