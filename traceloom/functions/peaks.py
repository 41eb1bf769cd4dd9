"""Small array helpers for peaks and runs in one piece of a trace."""

from __future__ import annotations

import numpy as np


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Positions of strict maxima; of a flat top the middle, rounded down; ends are none."""
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64)
    change = np.flatnonzero(x[1:] != x[:-1])
    first, last = np.r_[0, change + 1], np.r_[change, len(x) - 1]
    level = x[first]
    top = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:]) if len(level) > 2 else np.zeros(0, bool)
    return ((first[1:-1] + last[1:-1]) // 2)[top]


def _reach(x: np.ndarray, p: int, step: int) -> int:
    """The last position from ``p`` on in one direction before a higher value; looked for in stretches that double."""
    size, at = 64, p + step
    while 0 <= at < len(x):
        end = at + step * size
        part = x[at:end] if step > 0 else x[max(end + 1, 0) : at + 1][::-1]
        higher = np.flatnonzero(part > x[p])
        if len(higher):
            return at + step * int(higher[0]) - step
        at, size = end, size * 2
    return len(x) - 1 if step > 0 else 0


def prominences(x: np.ndarray, peaks: np.ndarray, reach: int | None = None) -> np.ndarray:
    """Height of each peak above the higher of the lowest points towards the next higher value on either side.

    With ``reach`` no more than so many values on either side are looked at.
    """
    out = np.empty(len(peaks))
    for i, p in enumerate(peaks):
        a, b = (0, len(x)) if reach is None else (max(p - reach, 0), p + reach + 1)
        y, q = x[a:b], p - a
        out[i] = x[p] - max(y[_reach(y, q, -1) : q + 1].min(), y[q : _reach(y, q, 1) + 1].min())
    return out


def find_peaks(x: np.ndarray, height: float, distance: int = 1, prominence: float | None = None, reach: int | None = None) -> np.ndarray:
    """Maxima at least ``height`` high; of those closer than ``distance`` the highest stay; then those prominent enough."""
    peaks = local_maxima(x)
    peaks = peaks[x[peaks] >= height]
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), dtype=bool)
        first, last = np.searchsorted(peaks, peaks - distance, "right"), np.searchsorted(peaks, peaks + distance, "left")
        for i in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[i]:
                keep[first[i] : i] = False
                keep[i + 1 : last[i]] = False
        peaks = peaks[keep]
    if prominence is not None and len(peaks):
        peaks = peaks[prominences(x, peaks, reach) >= prominence]
    return peaks


def run_starts(mask: np.ndarray, length: int) -> np.ndarray:
    """Whether ``length`` true values in a row begin at each position."""
    total = np.r_[0, np.cumsum(mask)]
    out = np.zeros(len(mask), dtype=bool)
    if length <= len(mask):
        out[: len(mask) - length + 1] = total[length:] - total[:-length] == length
    return out


def schmitt(score: np.ndarray, high: np.ndarray, low: np.ndarray, enter: int, leave: int) -> np.ndarray:
    """Mask of a trigger that goes on at ``enter`` values in a row above ``high`` and off at ``leave`` in a row at or below ``low``."""
    ok = np.isfinite(score) & np.isfinite(high) & np.isfinite(low)
    on, off = np.flatnonzero(run_starts((score > high) & ok, enter)), np.flatnonzero(run_starts((score <= low) & ok, leave))
    out = np.zeros(len(score), dtype=bool)
    at = 0
    while True:
        i = np.searchsorted(on, at)
        if i == len(on):
            return out
        start = on[i]
        j = np.searchsorted(off, start + enter)
        end = off[j] if j < len(off) else len(score)
        out[start:end] = True
        at = max(end + leave, start + enter)
        if j == len(off):
            return out


def zero_phase_butterworth(x: np.ndarray, fs: float, cutoff: float, order: int, highpass: bool, pad: int) -> np.ndarray:
    """Butterworth filter run forwards and backwards, as its squared gain over the spectrum of the mirrored signal."""
    if len(x) < 4:
        return x.copy()
    cutoff = min(cutoff, 0.95 * fs / 2)
    pad = min(pad, len(x) - 1)
    wide = np.pad(x, pad, mode="reflect")
    f = np.fft.rfftfreq(len(wide), 1 / fs)
    # the bilinear transform bends frequencies
    bend = np.tan(np.pi * np.minimum(f / fs, 0.4999999)) / np.tan(np.pi * cutoff / fs)
    with np.errstate(over="ignore", divide="ignore"):
        gain = 1 / (1 + bend ** (2 * order)) if not highpass else 1 / (1 + (1 / np.maximum(bend, 1e-12)) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(wide) * gain, len(wide))[pad : pad + len(x)]
