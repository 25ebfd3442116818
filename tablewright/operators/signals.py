"""Spectrograms and image batches: the two jobs that need NumPy inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import arrays


def _power(waves, n_fft: int, hop: int, rate: float):
    """Power spectral density of equally long waves, waves x frequencies x frames (tapered cosine window, mean removed)."""
    x = np.asarray(waves, dtype=float)
    if x.shape[1] < n_fft:
        x = np.pad(x, ((0, 0), (0, n_fft - x.shape[1])))
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft, axis=1)[:, ::hop]
    frames = frames - frames.mean(axis=2, keepdims=True)
    edge = 0.25 * (n_fft - 1) / 2
    i = np.arange(n_fft)
    dist = np.minimum(i, n_fft - 1 - i)
    win = np.where(dist < edge, 0.5 * (1 - np.cos(np.pi * dist / edge)), 1.0)
    p = np.abs(np.fft.rfft(frames * win, axis=2)) ** 2 / (rate * (win**2).sum())
    p[:, :, 1: p.shape[2] - (n_fft % 2 == 0)] *= 2
    return p.transpose(0, 2, 1)


def mel_weights(n_fft: int, rate: float, bands: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale from 0 to half the rate, bands x frequencies."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)
    low, mid, high = points[:-2, None], points[1:-1, None], points[2:, None]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))


def _in_groups(size, work, rows: int) -> list:
    """``work`` on the positions of each distinct size, one call per size in the batch; results in row order."""
    out = [None] * rows
    for s in set(size) - {None}:
        at = [i for i, x in enumerate(size) if x == s]
        for i, r in zip(at, work(at)):
            out[i] = r
    return out


def spectrogram(wave: Column, n_fft: int, hop: int, rate: float = 1.0, bands: int | None = None) -> Column:
    """array<array<double>>: power per frequency, or per mel band, and frame; the waves of an Arrow batch at once."""

    @F.pandas_udf("array<array<double>>")
    def run(s: pd.Series) -> pd.Series:
        def work(at):
            power = _power(np.stack([s.iloc[i] for i in at]), n_fft, hop, rate)
            return (power if bands is None else mel_weights(n_fft, rate, bands) @ power).tolist()

        return pd.Series(_in_groups([None if w is None else len(w) for w in s], work, len(s)), index=s.index)

    return run(wave)


def log_spectrogram(df: DataFrame, wave: str, n_fft: int, hop: int, width: int, rate: float = 1.0, bands: int | None = None) -> DataFrame:
    """Adds ``spectrogram``: decibels scaled to 0-1 over the whole picture, every row cut or padded to ``width`` frames."""
    power = df.withColumn("_power", spectrogram(F.col(wave), n_fft, hop, rate, bands))
    rows = F.transform("_power", arrays.decibel)
    scaled = power.withColumns({"_rows": rows, "_lo": F.array_min(F.flatten(rows)), "_hi": F.array_max(F.flatten(rows))})
    span = F.col("_hi") - F.col("_lo") + arrays.EPS
    out = F.transform("_rows", lambda r: arrays.pad(F.transform(r, lambda v: (v - F.col("_lo")) / span), width))
    return scaled.withColumn("spectrogram", out).drop("_power", "_rows", "_lo", "_hi")


def normalize_images(df: DataFrame, key: str, size: int, mean, sd) -> DataFrame:
    """(key, pixels): nearest-neighbour resize to size x size, then (x / 255 - mean) / sd per RGB channel.

    Input rows carry the fields of Spark's image source: height, width, nChannels and data (BGR order).
    A picture without data counts as black.
    """
    mu, sigma = np.asarray(mean, dtype=float), np.asarray(sd, dtype=float)
    kind = df.schema[key].dataType.simpleString()

    def batches(it):
        black = ((np.zeros((size, size, 3)) - mu) / sigma).ravel().tolist()
        for pdf in it:
            data = pdf["data"].tolist()
            shapes = [
                None if d is None or len(d) == 0 else (int(h), int(w), int(c))
                for h, w, c, d in zip(pdf["height"], pdf["width"], pdf["nChannels"], data)
            ]

            def work(at):
                h, w, c = shapes[at[0]]  # noqa: B023
                a = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), h, w, c)  # noqa: B023
                a = a[:, np.arange(size) * h // size][:, :, np.arange(size) * w // size]
                rgb = np.repeat(a, 3, axis=3) if c == 1 else a[:, :, :, 2::-1]
                return (((rgb / 255.0) - mu) / sigma).reshape(len(at), -1).tolist()

            yield pd.DataFrame({key: pdf[key], "pixels": [black if p is None else p for p in _in_groups(shapes, work, len(shapes))]})

    return df.select(key, "height", "width", "nChannels", "data").mapInPandas(batches, f"{key} {kind}, pixels array<double>")
