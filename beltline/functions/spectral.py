"""Small numpy helpers that pandas UDFs call on a batch of equally long windows (rows = windows)."""

from __future__ import annotations

import numpy as np

# Detector bands and spectrogram contract.
N_BANDS = 8
ENV_BAND = (0.5, 0.95)
SPECTRO_FRAMES, SPECTRO_BANDS, SPECTRO_EPS = 49, 40, 1e-3
GYRO_EPS = 0.85
TINY = 1e-12


def power(x: np.ndarray, n_fft: int | None = None) -> np.ndarray:
    """|rfft|^2 of Hann-windowed rows (symmetric window)."""
    return np.abs(np.fft.rfft(x * np.hanning(x.shape[1]), n=n_fft, axis=1)) ** 2


def shape_features(spec: np.ndarray, freqs: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Band fractions, centroid, spread, flatness, entropy, roll-off of power spectra."""
    nyq = fs / 2.0
    total = spec.sum(axis=1) + TINY
    p = spec / total[:, None]
    band_of = np.digitize(freqs, np.linspace(0.0, nyq, N_BANDS + 1)) - 1
    out = {f"band{b}": p[:, band_of == b].sum(axis=1) for b in range(N_BANDS)}
    out["hf_ratio"] = p[:, freqs >= nyq / 2].sum(axis=1)
    out["centroid"] = p @ freqs
    out["spread"] = np.sqrt(((freqs[None, :] - out["centroid"][:, None]) ** 2 * p).sum(axis=1))
    out["flatness"] = np.exp(np.log(spec + TINY).mean(axis=1)) / (spec.mean(axis=1) + TINY)
    out["entropy"] = -(p * np.log(p + TINY)).sum(axis=1)
    reach = np.minimum((np.cumsum(p, axis=1) < 0.85).sum(axis=1), len(freqs) - 1)
    out["rolloff"] = freqs[reach]
    return out


def tri_filterbank(n_freq: int, nyq: float, n_bands: int) -> np.ndarray:
    """Linearly spaced triangles over [0, nyq], one row per band."""
    f = np.linspace(0.0, nyq, n_freq)[None, :]
    edges = np.linspace(0.0, nyq, n_bands + 2)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2] + TINY)
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1] + TINY)
    return np.maximum(np.minimum(rise, fall), 0.0)


def band_energies(x: np.ndarray, fs: float, n_bands: int = 32, n_fft: int = 1024, eps: float = 1e-9) -> np.ndarray:
    """log1p energies of linear triangular bands, Welch-averaged over half-overlapping sub-frames."""
    n = min(n_fft, x.shape[1])
    fb = tri_filterbank(n // 2 + 1, fs / 2.0, n_bands)
    acc = [power(x[:, s:s + n]) for s in range(0, x.shape[1] - n + 1, n // 2)]
    return np.log1p(np.mean(acc, axis=0) @ fb.T / eps)


def tonal(x: np.ndarray, fs: float, f_lo: float, n_fft: int = 2048):
    """(peak-to-median power at and above ``f_lo``, frequency of that peak)."""
    n = min(n_fft, x.shape[1])
    freqs = np.fft.rfftfreq(n, 1.0 / fs)
    keep = freqs >= f_lo
    if n < 16 or not keep.any():
        return np.zeros(len(x)), np.zeros(len(x))
    hb = power(x[:, :n])[:, keep]
    return hb.max(axis=1) / (np.median(hb, axis=1) + TINY), freqs[keep][hb.argmax(axis=1)]


def spectrogram_geometry(fs: float, n: int):
    n_fft = int(np.clip(2 ** max(0, int(np.ceil(np.log2(max(1.0, fs * 0.02))))), 16, 256))
    return n_fft, max(1, (n - n_fft) // (SPECTRO_FRAMES - 1))


def spectrogram(x: np.ndarray, fs: float, eps: float = SPECTRO_EPS) -> np.ndarray:
    """Rows of mean-free magnitude to ``[rows, 49, 40]`` log filterbank energies."""
    n_fft, hop = spectrogram_geometry(fs, x.shape[1])
    fb = tri_filterbank(n_fft // 2 + 1, fs / 2.0, SPECTRO_BANDS)
    starts = list(range(0, x.shape[1] - n_fft + 1, hop))[:SPECTRO_FRAMES]
    frames = np.stack([power(x[:, s:s + n_fft]) @ fb.T for s in starts], axis=1)
    pad = SPECTRO_FRAMES - frames.shape[1]
    if pad > 0:
        frames = np.concatenate([frames, np.repeat(frames[:, -1:], pad, axis=1)], axis=1)
    return np.log1p(frames / eps)


# --- Butterworth filters -----------------------------------------------------------------------

def butter_sos(order: int, cut, kind: str) -> np.ndarray:
    """Second-order sections of a Butterworth filter; ``cut`` as a fraction of Nyquist."""
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warped = np.tan(np.pi * np.atleast_1d(np.asarray(cut, float)) / 2)
    if kind == "low":
        p, z, gain = warped[0] * poles, [], warped[0] ** order
    elif kind == "high":
        p, z, gain = warped[0] / poles, [0.0] * order, 1.0
    else:
        bw, w0 = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * bw / 2
        root = np.sqrt(half**2 - w0**2 + 0j)
        p, z, gain = np.concatenate([half + root, half - root]), [0.0] * order, bw**order
    z = np.asarray(z, complex)
    gain = gain * np.real(np.prod(1 - z) / np.prod(1 - p))
    zd = np.concatenate([(1 + z) / (1 - z), -np.ones(len(p) - len(z))])
    pd_ = (1 + p) / (1 - p)
    upper = sorted(pd_[pd_.imag > 1e-12], key=lambda v: abs(v))
    real = sorted(pd_[np.abs(pd_.imag) <= 1e-12].real, key=abs)
    zeros = sorted(zd.real)
    zeros = [v for pair in zip(zeros[: len(zeros) // 2], zeros[::-1]) for v in pair] if kind == "band" else zeros
    sos = []
    for q in upper:
        zz = [zeros.pop(0), zeros.pop(0)]
        sos.append([1.0, -(zz[0] + zz[1]), zz[0] * zz[1], 1.0, -2 * q.real, abs(q) ** 2])
    while len(real) >= 2:
        a, b = real.pop(0), real.pop(0)
        zz = [zeros.pop(0), zeros.pop(0)]
        sos.append([1.0, -(zz[0] + zz[1]), zz[0] * zz[1], 1.0, -(a + b), a * b])
    if real:
        sos.append([1.0, -zeros.pop(0), 0.0, 1.0, -real[0], 0.0])
    sos = np.array(sos)
    sos[0, :3] *= gain
    return sos


def settling(sos: np.ndarray, tolerance: float) -> int:
    """Samples after which the response of the slowest pole is below ``tolerance``."""
    slowest = max(np.abs(np.roots(section[3:])).max() for section in sos)
    return int(np.ceil(np.log(tolerance) / np.log(slowest))) if 0 < slowest < 1 else 1


def _pass(sos, x):
    """One direction over rows, starting from the steady state of each row's first sample."""
    y = x
    level = x[:, 0]
    for b0, b1, b2, _, a1, a2 in sos:
        out = np.empty_like(y)
        dc = (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = (b2 - a2 * dc) * level
        s1 = (b1 - a1 * dc) * level + s2
        for i in range(y.shape[1]):
            v = y[:, i]
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            out[:, i] = o
        y, level = out, dc * level
    return y


def zero_phase(sos: np.ndarray, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    """Forward-backward filtering of rows with odd extension at both ends."""
    if pad is None:
        pad = 3 * (2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum()))
    pad = int(min(pad, x.shape[1] - 1))
    ext = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2:-pad - 2:-1]], axis=1)
    y = _pass(sos, _pass(sos, ext)[:, ::-1])[:, ::-1]
    return y[:, pad:pad + x.shape[1]]


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of rows."""
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1:(n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1))


def moment(x: np.ndarray, k: int) -> np.ndarray:
    """Standardised moment of rows; 0 where the row is constant."""
    d = x - x.mean(axis=1, keepdims=True)
    s = d.std(axis=1)
    safe = np.where(s > TINY, s, 1.0)
    return np.where(s > TINY, ((d / safe[:, None]) ** k).mean(axis=1), 0.0)


def envelope_features(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    zero = np.zeros(len(x))
    sos = butter_sos(2, ENV_BAND, "band")
    if x.shape[1] < 16 or x.shape[1] <= 3 * (2 * len(sos) + 1):
        return {"env_rms": zero, "env_kurtosis": zero, "env_p2p": zero}
    e = envelope(zero_phase(sos, x))
    e = e - e.mean(axis=1, keepdims=True)
    return {"env_rms": np.sqrt((e * e).mean(axis=1)), "env_kurtosis": moment(e, 4), "env_p2p": np.ptp(e, axis=1)}


def time_features(x: np.ndarray) -> dict[str, np.ndarray]:
    rms = np.sqrt((x * x).mean(axis=1))
    peak = np.abs(x).max(axis=1)
    d = np.diff(x, axis=1)
    return {
        "rms": rms, "p2p": np.ptp(x, axis=1), "std": x.std(axis=1),
        "crest": np.where(rms > TINY, peak / np.where(rms > TINY, rms, 1.0), 0.0),
        "jerk_mad": np.abs(d).mean(axis=1), "kurtosis": moment(x, 4), "skew": moment(x, 3),
        "zcr": (np.abs(np.diff(np.sign(x), axis=1)) > 0).mean(axis=1)}


def by_length(arrays, fn):
    """Apply ``fn(matrix) -> dict of columns`` to windows grouped by length; rows keep their place."""
    import pandas as pd

    lengths = arrays.map(len).to_numpy()
    parts = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        x = np.stack([np.asarray(arrays.iloc[i], dtype=np.float64) for i in at])
        parts.append(pd.DataFrame(fn(x), index=at))
    return pd.concat(parts).sort_index().reset_index(drop=True) if parts else pd.DataFrame(fn(np.zeros((0, 64))))
