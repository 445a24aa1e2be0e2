"""Signal kernels with no relational form, in numpy behind grouped maps.

A group is one participant's signal or one window of it. Filters are
recursive digital Butterworth filters run forward and backward; published
definitions are followed, edge conventions are this module's own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chronosift.shipping import ship

# --- filters -------------------------------------------------------------------------------------


def butter(order: int, cutoff, fs: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth (b, a) by the bilinear transform; kind low, high or band."""
    nyquist = fs / 2
    w = np.atleast_1d(np.asarray(cutoff, dtype=float)) / nyquist
    warped = 4 * np.tan(np.pi * np.clip(w, 1e-9, 1 - 1e-9) / 2)
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    if kind == "low":
        z, p, gain = np.array([]), poles * warped[0], warped[0] ** order
    elif kind == "high":
        z, p, gain = np.zeros(order), warped[0] / poles, np.real(1 / np.prod(-poles))
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        z, p, gain = np.zeros(order), np.concatenate([half + root, half - root]), width**order
    zd, pd_ = (4 + z) / (4 - z), (4 + p) / (4 - p)
    gain = gain * np.real(np.prod(4 - z) / np.prod(4 - p))
    zd = np.concatenate([zd, -np.ones(len(pd_) - len(zd))])
    return gain * np.real(np.poly(zd)), np.real(np.poly(pd_))


def recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed, from a state."""
    b, a, z = b / a[0], a / a[0], state.copy()
    y = np.empty_like(x)
    for i, v in enumerate(x):
        out = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * out
        z[-1] = b[-1] * v - a[-1] * out
        y[i] = out
    return y


def settled_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of a filter that has seen ones for ever."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:] / a[0]
    companion[:-1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, (b[1:] - a[1:] / a[0] * b[0]) / a[0])


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering with odd extension at both ends."""
    pad = min(3 * max(len(a), len(b)), len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
    zi = settled_state(b, a)
    y = recursive(b, a, ext, zi * ext[0])
    y = recursive(b, a, y[::-1], zi * y[-1])[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


def filtered(x: np.ndarray, order: int, cutoff, fs: float, kind: str) -> np.ndarray:
    return both_ways(*butter(order, cutoff, fs, kind), np.asarray(x, dtype=float))


# --- peaks and spectra ---------------------------------------------------------------------------


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places of strict maxima; of a plateau its middle."""
    edges = np.flatnonzero(np.diff(x) != 0)
    if len(edges) < 2:
        return np.empty(0, dtype=int)
    first, last = edges[:-1] + 1, edges[1:]
    top = (x[first - 1] < x[first]) & (x[last + 1] < x[last])
    return (first[top] + last[top]) // 2


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of peaks above the higher of the lowest samples on either side, up to a higher peak or the end.

    Only maxima, the ends and the lowest samples between them matter: a stack of
    the higher ones passes each once.
    """
    places = np.unique(np.concatenate([[0], local_maxima(x), [len(x) - 1]]))
    heights = x[places]
    lows = np.minimum(np.minimum.reduceat(x, places[:-1]), heights[1:]) if len(places) > 1 else np.empty(0)

    def lowest(h: np.ndarray, between: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(h)), []
        for i, v in enumerate(h):
            low = min(v, between[i - 1]) if i else v
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            out[i] = low
            stack.append((v, low))
        return out

    base = np.maximum(lowest(heights, lows), lowest(heights[::-1], lows[::-1])[::-1])
    return (heights - base)[np.searchsorted(places, peaks)]


def find_peaks(x: np.ndarray, distance: int = 1, height: float | None = None, prominence: float | None = None) -> np.ndarray:
    """Local maxima of a least height, the highest kept where two are closer than distance, of a least prominence."""
    x = np.asarray(x, dtype=float)
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), dtype=bool)
        for i in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[i]:
                a, b = np.searchsorted(peaks, [peaks[i] - distance + 1, peaks[i] + distance])
                keep[a:b] = False
                keep[i] = True
        peaks = peaks[keep]
    if prominence is not None and len(peaks):
        peaks = peaks[prominences(x, peaks) >= prominence]
    return peaks


def welch(x: np.ndarray, fs: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power density: Hann windows that overlap by half, means removed."""
    x = np.asarray(x, dtype=float)
    n = min(segment, len(x))
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = []
    for at in range(0, len(x) - n + 1, max(1, n - n // 2)):
        part = x[at : at + n]
        power.append(np.abs(np.fft.rfft((part - part.mean()) * win)) ** 2)
    density = np.mean(power, axis=0) / (fs * (win**2).sum())
    density[1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n, 1 / fs), density


def band_power(freq: np.ndarray, density: np.ndarray, low: float, high: float) -> float:
    inside = (freq >= low) & (freq <= high)
    return float(np.trapezoid(density[inside], freq[inside])) if inside.sum() > 1 else 0.0


# --- heart ---------------------------------------------------------------------------------------


def ecg_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """R peaks of 2 s of signal or more: band-pass 5-15 Hz, squared slope, 150 ms moving mean, peaks at least 0.3 s apart. None below some 10 Hz, where the band is empty."""
    high = min(15.0, 0.99 * fs / 2)
    if len(x) < fs * 2 or high <= 5:
        return np.empty(0, dtype=int)
    energy = np.diff(filtered(x, 2, (5.0, high), fs, "band")) ** 2
    width = max(1, int(0.15 * fs))
    smooth = np.convolve(energy, np.ones(width) / width, mode="same")
    return find_peaks(smooth, max(1, int(0.3 * fs)), smooth.mean() + 0.5 * smooth.std())


def pulse_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Beats of a blood volume pulse of 0.5 s or more, and of more samples than the filter's padding (15): band-pass 0.5-8 Hz, from 1 % of half the rate at least, peaks at least 0.3 s apart and prominent."""
    if len(x) < fs * 0.5 or len(x) <= 15:
        return np.empty(0, dtype=int)
    y = filtered(x, 2, (max(0.5, 0.01 * fs / 2), min(8.0, 0.99 * fs / 2)), fs, "band")
    return find_peaks(y, max(1, int(0.3 * fs)), y.mean() + 0.3 * y.std(), 0.1 * y.std())


def plausible_ibi(peaks: np.ndarray, fs: float) -> np.ndarray:
    ibi = np.diff(peaks) / fs * 1000
    return ibi[(ibi > 300) & (ibi < 2000)]


def pulse_features(x: np.ndarray, fs: float) -> dict[str, float]:
    """Deviation, peak to peak, and power in 0.5-4 Hz (0 with fewer than 8 samples)."""
    x = np.asarray(x, dtype=float)
    if not len(x):
        return {"bvp_std": np.nan, "bvp_peak_to_peak": np.nan, "bvp_spectral_power": np.nan}
    power = band_power(*welch(x, fs, min(len(x), 64)), 0.5, 4.0) if len(x) >= 8 else 0.0
    return {"bvp_std": float(x.std(ddof=1)) if len(x) > 1 else 0.0, "bvp_peak_to_peak": float(np.ptp(x)), "bvp_spectral_power": power}


def hrv_spectrum(ibi_ms: np.ndarray, rate: float = 4.0) -> dict[str, float]:
    """Powers of the tachogram resampled evenly: vlf, lf, hf, their normal units, ratio and ln(hf); null with fewer than 10 intervals. And the triangular index."""
    ibi = np.asarray(ibi_ms, dtype=float)
    ibi = ibi[(ibi > 300) & (ibi < 2000)]
    keys = ("hrv_lf", "hrv_hf", "hrv_vlf", "hrv_lf_hf_ratio", "hrv_lfn", "hrv_hfn", "hrv_lnhf", "hrv_hti")
    if len(ibi) < 3:
        return dict.fromkeys(keys, np.nan)
    width = 1000 / 128
    counts = np.bincount(((ibi - ibi.min()) / width).astype(int))
    out = dict.fromkeys(keys, np.nan) | {"hrv_hti": len(ibi) / counts.max()}
    if len(ibi) < 10:
        return out
    t = np.cumsum(ibi) / 1000
    grid = np.arange(t[0], t[-1], 1 / rate)
    freq, density = welch(np.interp(grid, t, ibi), rate, len(grid))
    vlf, lf, hf = band_power(freq, density, 0.0033, 0.04), band_power(freq, density, 0.04, 0.15), band_power(freq, density, 0.15, 0.4)
    total = lf + hf
    return out | {"hrv_lf": lf, "hrv_hf": hf, "hrv_vlf": vlf, "hrv_lf_hf_ratio": lf / hf if hf else np.nan, "hrv_lfn": lf / total if total else np.nan, "hrv_hfn": hf / total if total else np.nan, "hrv_lnhf": float(np.log(hf)) if hf > 0 else np.nan}


# --- skin ----------------------------------------------------------------------------------------


def skin_components(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(tonic, phasic): a 0.05 Hz high-pass splits the signal; short signals are all tonic."""
    x = np.asarray(x, dtype=float)
    if len(x) < 4:
        return x, np.zeros_like(x)
    phasic = filtered(x, 2, 0.05, fs, "high")
    return x - phasic, phasic


def skin_features(x: np.ndarray, tonic: np.ndarray | None, phasic: np.ndarray | None, fs: float, least: float = 0.01) -> dict[str, float]:
    """Features of a window. An empty window has 0 peaks and else nulls; without components, amplitude and area are null."""
    keys = ("eda_mean", "eda_std", "eda_max", "eda_scr_mean_amp", "eda_scr_auc")
    if not len(x):
        return dict.fromkeys(keys, np.nan) | {"eda_peaks": 0.0}
    x = np.asarray(x, dtype=float)
    deviation = lambda v: float(np.std(v, ddof=1)) if len(v) > 1 else 0.0
    if tonic is None or phasic is None:
        return {"eda_mean": float(x.mean()), "eda_std": deviation(x), "eda_max": float(x.max()), "eda_peaks": 0.0, "eda_scr_mean_amp": np.nan, "eda_scr_auc": np.nan}
    peaks = find_peaks(phasic, 1, least)
    return {
        "eda_mean": float(np.mean(tonic)), "eda_std": deviation(phasic), "eda_max": float(x.max()), "eda_peaks": float(len(peaks)),
        "eda_scr_mean_amp": float(np.mean(phasic[peaks])) if len(peaks) else 0.0, "eda_scr_auc": float(np.trapezoid(np.clip(phasic, 0, None), dx=1 / fs)),
    }


# --- grouped maps --------------------------------------------------------------------------------


def _schema(by: list[str], df: DataFrame, more: str) -> str:
    ship(df.sparkSession)  # each grouped map comes by here
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + ", " + more


def peaks(signals: DataFrame, by: list[str], fs: float, kind: str = "ecg") -> DataFrame:
    """by, ts of each beat of a signal (ts, value)."""
    find = ecg_peaks if kind == "ecg" else pulse_peaks

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        at = find(pdf["value"].to_numpy(dtype=float), fs)
        return pdf.iloc[at][[*by, "ts"]]

    return signals.groupBy(*by).applyInPandas(run, _schema(by, signals, "ts double"))


def skin_windows(signals: DataFrame, by: list[str], fs: float, width: float) -> DataFrame:
    """by, seconds and skin features: components over the whole signal, features in its windows."""
    names = ["eda_mean", "eda_std", "eda_max", "eda_peaks", "eda_scr_mean_amp", "eda_scr_auc"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        x, ts = pdf["value"].to_numpy(dtype=float), pdf["ts"].to_numpy(dtype=float)
        tonic, phasic = skin_components(x, fs)
        rows = []
        for w in np.unique(np.floor(ts / width)):
            a, b = np.searchsorted(ts, [w * width, (w + 1) * width])
            rows.append([*pdf.iloc[0][by], (w + 1) * width, *[skin_features(x[a:b], tonic[a:b], phasic[a:b], fs)[n] for n in names]])
        return pd.DataFrame(rows, columns=[*by, "seconds", *names])

    return signals.groupBy(*by).applyInPandas(run, _schema(by, signals, ", ".join(f"{n} double" for n in ["seconds", *names])))


def pulse_windows(signals: DataFrame, by: list[str], fs: float, width: float) -> DataFrame:
    """by, seconds and pulse features of each window; a task holds one window's samples only."""
    from pyspark.sql import functions as F

    names = ["bvp_std", "bvp_peak_to_peak", "bvp_spectral_power"]
    rows = signals.withColumn("seconds", (F.floor(F.col("ts") / width) + 1) * float(width))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        f = pulse_features(pdf["value"].to_numpy(dtype=float), fs)
        return pd.DataFrame([[*pdf.iloc[0][[*by, "seconds"]], *[f[n] for n in names]]], columns=[*by, "seconds", *names])

    return rows.groupBy(*by, "seconds").applyInPandas(run, _schema([*by, "seconds"], rows, ", ".join(f"{n} double" for n in names)))


def hrv_frequency(beats: DataFrame, by: list[str], ts: str = "ts", ibi: str = "ibi") -> DataFrame:
    """by and frequency-domain variability of the intervals (ms) in order."""
    names = ["hrv_lf", "hrv_hf", "hrv_vlf", "hrv_lf_hf_ratio", "hrv_lfn", "hrv_hfn", "hrv_lnhf", "hrv_hti"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = hrv_spectrum(pdf.sort_values(ts, kind="stable")[ibi].to_numpy(dtype=float))
        return pd.DataFrame([[*pdf.iloc[0][by], *[f[n] for n in names]]], columns=[*by, *names])

    return beats.groupBy(*by).applyInPandas(run, _schema(by, beats, ", ".join(f"{n} double" for n in names)))
