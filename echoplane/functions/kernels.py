"""Numerical kernels on single series (numpy arrays), which grouped operators run in their tasks."""

from __future__ import annotations

import math
import warnings

import numpy as np

# ------------------------------------------------------------------ spectra and filters


def welch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(f, density): mean periodogram of Hann-windowed, centred segments of min(n, 256), half overlapping."""
    n = min(len(x), 256)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = max(1, n - n // 2)
    parts = np.stack([x[s : s + n] for s in range(0, len(x) - n + 1, step)])
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (w**2).sum()
    power[:, 1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n), power.mean(axis=0)


def spectral_slope(x: np.ndarray, method: str = "welch") -> float:
    """beta of power ~ 1 / f**beta; nan with under two usable points."""
    x = np.asarray(x, float) - np.mean(x)
    f, p = welch(x) if method == "welch" else (np.fft.rfftfreq(len(x)), np.abs(np.fft.rfft(x)) ** 2 / len(x))
    ok = (f > 0) & (p > 0)
    if ok.sum() < 2:
        return math.nan
    return float(-np.polyfit(np.log10(f[ok]), np.log10(p[ok]), 1)[0])


def butter_high(order: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a Butterworth high-pass; cut is a share of the Nyquist frequency."""
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    poles = 4 * np.tan(np.pi * cut / 2) / proto
    gain = np.real(1 / np.prod(-proto)) * np.real(4.0**order / np.prod(4 - poles))
    return gain * np.real(np.poly(np.ones(order))), np.real(np.poly((4 + poles) / (4 - poles)))


def _iir(b, a, x, state):
    out = np.empty(len(x))
    for k, v in enumerate(x):
        out[k] = b[0] * v + state[0]
        state[:-1] = state[1:] + b[1:-1] * v - a[1:-1] * out[k]
        state[-1] = b[-1] * v - a[-1] * out[k]
    return out


def filter_both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering, with ends reflected through their points and settled filter states."""
    pad = min(3 * len(a), len(x) - 1)
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    m = len(a) - 1
    companion = np.zeros((m, m))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(m - 1)
    settled = np.linalg.solve(np.eye(m) - companion, b[1:] - a[1:] * b[0])
    y = _iir(b, a, long, settled * long[0])
    y = _iir(b, a, y[::-1], settled * y[-1])[::-1]
    return y[pad : len(y) - pad]


def pink_filter(x: np.ndarray, threshold: float = 0.5, cutoff: float = 0.05, order: int = 4) -> tuple[np.ndarray, float, bool]:
    """(series, beta, filtered): high-passed where the spectral slope reaches threshold. As in the
    established method, the edge lies at half of cutoff."""
    x, beta = np.asarray(x, float), spectral_slope(x)
    if beta >= threshold and len(x) > 1:
        return filter_both_ways(*butter_high(order, cutoff / 2), x), beta, True
    return x, beta, False


def pchip(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation (Fritsch and Carlson's harmonic slopes) of (t, v) at places."""
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    m = np.zeros(len(t))
    if len(t) == 2:
        m[:] = d[0]
    elif len(t) > 2:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = d[:-1] * d[1:] > 0
        m[1:-1][same] = (w1 + w2)[same] / (w1[same] / d[:-1][same] + w2[same] / d[1:][same])
        for end, h0, h1, d0, d1 in ((0, h[0], h[1], d[0], d[1]), (-1, h[-1], h[-2], d[-1], d[-2])):
            e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            m[end] = 0 if e * d0 <= 0 else 3 * d0 if d0 * d1 < 0 and abs(e) > 3 * abs(d0) else e
    k = np.clip(np.searchsorted(t, at, "right") - 1, 0, len(t) - 2)
    s = (at - t[k]) / h[k]
    return v[k] * (1 + 2 * s) * (1 - s) ** 2 + h[k] * m[k] * s * (1 - s) ** 2 + v[k + 1] * s**2 * (3 - 2 * s) + h[k] * m[k + 1] * s**2 * (s - 1)


# ------------------------------------------------------------------ surrogates


def _rank_map(like: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values (sorted) in the rank order of like."""
    out = np.empty(len(like))
    out[np.argsort(like, kind="stable")] = values
    return out


def _phases(x: np.ndarray, rng) -> np.ndarray:
    f = np.abs(np.fft.rfft(x))
    return np.fft.irfft(f * np.exp(1j * rng.uniform(0, 2 * np.pi, len(f))), n=len(x))


def _alternate(y: np.ndarray, spectrum: np.ndarray, values: np.ndarray, rounds: int, end: str = "values") -> np.ndarray:
    """Imposes a spectrum and a set of values in turn; ends with the one named."""
    for _ in range(rounds):
        s = np.fft.irfft(spectrum * np.exp(1j * np.angle(np.fft.rfft(y))), n=len(y))
        y = _rank_map(s, values)
    return s if end == "spectrum" and rounds else y


def ft(x, rng):
    return _phases(x - x.mean(), rng)


def aaft(x, rng):
    x = x - x.mean()
    gauss = _rank_map(x, np.sort(rng.normal(size=len(x))))
    return _rank_map(_phases(gauss, rng), np.sort(x))


def iaaft(x, rng, rounds: int = 100, end: str = "values"):
    x = x - x.mean()
    return _alternate(rng.permutation(x), np.abs(np.fft.rfft(x)), np.sort(x), rounds, end)


def idfs(x, rng, rounds: int = 50):
    x = x - x.mean()
    return _alternate(np.sort(x), np.abs(np.fft.rfft(rng.permutation(x))), np.sort(x), rounds)


#: Daubechies' scaling filter with four vanishing moments.
_DB4 = np.array([0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278])


def wavelet_levels(x: np.ndarray) -> list[np.ndarray]:
    """Periodic wavelet transform: approximation, then details from coarse to fine. The length must
    be a multiple of two to the power of the levels."""
    low, high = _DB4, _DB4[::-1] * (-1) ** np.arange(8)
    out = []
    levels = max(0, int(math.log2(len(x) / 7))) if len(x) >= 7 else 0
    while levels > len(out) and len(x) % 2 == 0:
        at = (2 * np.arange(len(x) // 2)[:, None] + np.arange(8)) % len(x)
        out.append(x[at] @ high)
        x = x[at] @ low
    return [x, *out[::-1]]


def wavelet_inverse(levels: list[np.ndarray]) -> np.ndarray:
    low, high = _DB4, _DB4[::-1] * (-1) ** np.arange(8)
    x = levels[0]
    for d in levels[1:]:
        out = np.zeros(2 * len(x))
        at = (2 * np.arange(len(x))[:, None] + np.arange(8)) % len(out)
        np.add.at(out, at, x[:, None] * low + d[:, None] * high)
        x = out
    return x


def wiaaft(x, rng, rounds: int = 20):
    """IAAFT of every wavelet level but the finest, each turned round where that is nearer."""
    x = x - x.mean()
    n = len(x)
    unit = 2 ** max(0, int(math.log2(n / 7))) if n >= 7 else 1
    long = np.concatenate([x, x[::-1][: -n % unit]])  # a whole number of coarsest steps
    levels = wavelet_levels(long)
    for k, c in enumerate(levels[:-1]):
        s = _alternate(rng.permutation(c), np.abs(np.fft.rfft(c)), np.sort(c), rounds)
        levels[k] = s[::-1] if np.linalg.norm(c - s) > np.linalg.norm(c - s[::-1]) else s
    return wavelet_inverse(levels)[:n]


def first_negative_acf(x: np.ndarray) -> int:
    c = np.correlate(x, x, "full")[len(x) - 1 :]
    below = np.flatnonzero(c < 0)
    return int(below[0]) if len(below) else 1


def pps(x, rng, dim: int = 10, noise: float | None = None):
    """A noisy walk among the states of the series. Without noise given it is 0.7 of the mean distance
    to the nearest other state."""
    x = x - x.mean()
    tau = first_negative_acf(x)
    dim = max(1, min(dim, (len(x) - 2) // tau + 1))
    e = np.stack([x[k : len(x) - (dim - 1) * tau + k] for k in range(0, dim * tau, tau)], axis=1)
    if noise is None:
        d = np.linalg.norm(e[:, None] - e[None], axis=2)
        np.fill_diagonal(d, np.inf)
        noise = 0.7 * float(np.min(d, axis=1).mean()) if len(e) > 1 else 0.0
    restart = int(np.argmin(np.linalg.norm(e[: max(1, len(e) // 2)] - e[-1], axis=1)))
    at = int(rng.integers(len(e)))
    path = [at]
    while len(path) < len(x):
        j = int(np.argmin(np.linalg.norm(e - (e[at] + rng.normal(scale=noise, size=dim)), axis=1)))
        at = (restart if j == len(e) - 1 else j) + 1 if len(e) > 1 else 0
        path.append(at)
    return e[path, 0]


def permuted(x, rng):
    return rng.permutation(x)


def shifted(x, rng):
    return np.roll(x, int(rng.integers(len(x))))


def _cycles(x: np.ndarray) -> list[np.ndarray]:
    """The series cut at its local maxima above the mean."""
    peaks = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] > x.mean())) + 1
    return np.split(x, peaks)


def cycle_shuffled(x, rng):
    """Whole cycles in another order; what comes before the first and after the last peak stays."""
    parts = _cycles(x)
    if len(parts) < 4:
        return x.copy()
    inner = parts[1:-1]
    return np.concatenate([parts[0], *(inner[k] for k in rng.permutation(len(inner))), parts[-1]])


def cyclic_phase(x, rng):
    """Phases of the analytic signal, cut into turns that are put in another order."""
    spectrum = np.fft.fft(x - x.mean())
    spectrum[len(x) // 2 + 1 :] = 0
    spectrum[1 : (len(x) + 1) // 2] *= 2
    phase = np.angle(np.fft.ifft(spectrum))
    turns = np.split(phase, np.flatnonzero(np.diff(phase) < -np.pi) + 1)
    if len(turns) < 4:
        return phase
    inner = turns[1:-1]
    return np.concatenate([turns[0], *(inner[k] for k in rng.permutation(len(inner))), turns[-1]])


def twin(x, rng, dim: int = 3, share: float = 0.1):
    """A walk that may jump between states with the same recurrence neighbourhood."""
    tau = first_negative_acf(x - x.mean())
    dim = max(1, min(dim, (len(x) - 2) // tau + 1))
    e = np.stack([x[k : len(x) - (dim - 1) * tau + k] for k in range(0, dim * tau, tau)], axis=1)
    d = np.abs(e[:, None] - e[None]).max(axis=2)
    near = d < np.quantile(d, share)
    _, kind = np.unique(near, axis=0, return_inverse=True)
    groups = {g: np.flatnonzero(kind == g) for g in np.unique(kind)}
    at, out = int(rng.integers(len(e))), []
    while len(out) < len(x):
        out.append(e[at, 0])
        mates = groups[kind[at]]
        at = int(mates[rng.integers(len(mates))]) + 1
        if at >= len(e):
            at = int(rng.integers(len(e)))
    return np.array(out)


def alternate_all(kind: str, x: np.ndarray, rngs: list) -> np.ndarray:
    """IAAFT (either end) or IDFS of many series (b, n) of one length, each with its own draws: what `iaaft` and
    `idfs` make of each."""
    x = x - x.mean(axis=1, keepdims=True)
    mixed, values = np.stack([r.permutation(v) for r, v in zip(rngs, x)]), np.sort(x, axis=1)
    y, spectrum, rounds = (values, np.abs(np.fft.rfft(mixed)), 50) if kind == "IDFS" else (mixed, np.abs(np.fft.rfft(x)), 100)
    for _ in range(rounds):
        s = np.fft.irfft(spectrum * np.exp(1j * np.angle(np.fft.rfft(y))), n=x.shape[1])
        y = np.empty_like(s)
        np.put_along_axis(y, np.argsort(s, axis=1, kind="stable"), values, axis=1)
    return s if kind == "IAAFT2" else y


#: Kinds that are made of many series at once.
TOGETHER = ("IAAFT", "IDFS", "IAAFT1", "IAAFT2")
SURROGATES = {"FT": ft, "AAFT": aaft, "IAAFT": iaaft, "IDFS": idfs, "WIAAFT": wiaaft, "PPS": pps}
LEGACY_SURROGATES = {
    "RP": permuted, "FT": ft, "AAFT": aaft, "IAAFT1": iaaft, "IAAFT2": lambda x, rng: iaaft(x, rng, end="spectrum"),
    "CPP": cyclic_phase, "PPS": pps, "TS": twin, "tshift": shifted, "CSS": cycle_shuffled,
}

# ------------------------------------------------------------------ dynamical systems


def _chua_h(x, m0, m1):
    return m1 * x + 0.5 * (m0 - m1) * (np.abs(x + 1) - np.abs(x - 1))


#: name -> (derivative of states (batch, 3) under parameters, defaults)
FLOWS = {
    "rossler": (lambda s, p: np.stack([-s[:, 1] - s[:, 2], s[:, 0] + p["a"] * s[:, 1], p["b"] + s[:, 2] * (s[:, 0] - p["c"])], 1), {"a": 0.2, "b": 0.2, "c": 5.7}),
    "lorenz": (lambda s, p: np.stack([p["sigma"] * (s[:, 1] - s[:, 0]), s[:, 0] * (p["rho"] - s[:, 2]) - s[:, 1], s[:, 0] * s[:, 1] - p["beta"] * s[:, 2]], 1), {"sigma": 10.0, "rho": 28.0, "beta": 8 / 3}),
    "chua": (lambda s, p: np.stack([p["alpha"] * (s[:, 1] - s[:, 0] - _chua_h(s[:, 0], p["m0"], p["m1"])), s[:, 0] - s[:, 1] + s[:, 2], -p["beta"] * s[:, 1]], 1), {"alpha": 15.6, "beta": 28.0, "m0": -1.143, "m1": -0.714}),
}
STARTS = {"rossler": (1.0, 1.0, 1.0), "lorenz": (1.0, 1.0, 1.0), "chua": (0.1, 0.1, 0.1)}


def integrate(f, start: np.ndarray, times: np.ndarray, substep: float = 0.001) -> np.ndarray:
    """States (len(times), batch, dims) by classical Runge-Kutta steps of at most substep."""
    out, s = [start], start
    for t0, t1 in zip(times[:-1], times[1:]):
        k = max(1, math.ceil((t1 - t0) / substep - 1e-9))
        h = (t1 - t0) / k
        for _ in range(k):
            k1 = f(s)
            k2 = f(s + h / 2 * k1)
            k3 = f(s + h / 2 * k2)
            s = s + h / 6 * (k1 + 2 * k2 + 2 * k3 + f(s + h * k3))
        out.append(s)
    return np.stack(out)


def euler(system: str, steps: int, dt: float, params: dict, start) -> np.ndarray:
    """(steps, batch, 3) by explicit Euler steps, the first row being the start."""
    f, _ = FLOWS[system]
    s, out = np.array(start, float), []
    for _ in range(steps):
        out.append(s)
        s = s + dt * f(s, params)
    return np.stack(out)


def flow(system: str, n: int, tmax: int, dt: float, params: dict[str, np.ndarray], start: np.ndarray) -> np.ndarray:
    """(n, batch, 3): every (tmax // n)-th of tmax samples dt apart."""
    f, _ = FLOWS[system]
    if tmax < n:
        raise ValueError("tmax must not be smaller than n")
    step = tmax // n
    times = np.linspace(0, tmax * dt, tmax)[::step][:n]
    return integrate(lambda s: f(s, params), start, times)


def henon(n: int, a, b, start) -> np.ndarray:
    x, y = np.array(start[0], float), np.array(start[1], float)
    out = []
    for _ in range(n):
        out.append(np.stack([x, y], -1))
        x, y = 1 - a * x * x + y, b * x
    return np.stack(out)


def kuramoto(n: int, n_osc: int, coupling: float, omega_sd: float, tmax: float, rng) -> np.ndarray:
    """(n, n_osc): sines of the phases."""
    omega, theta = rng.normal(0, omega_sd, n_osc), rng.uniform(0, 2 * np.pi, n_osc)

    def f(s):
        z = np.exp(1j * s).mean(axis=1, keepdims=True)
        return omega + coupling * np.imag(z * np.exp(-1j * s))

    return np.sin(integrate(f, theta[None], np.linspace(0, tmax, n), 0.02)[:, 0])


# ------------------------------------------------------------------ curves and bootstraps


def repeated_folds(n: int, folds: int, repeats: int, seed: int = 1):
    """Training and test rows of repeated folds over shuffled rows, in the established order of draws."""
    rng = np.random.RandomState(seed)
    for _ in range(repeats):
        rows = np.arange(n)
        rng.shuffle(rows)
        for part in np.array_split(rows, folds):
            out = np.zeros(n, bool)
            out[part] = True
            yield np.flatnonzero(~out), np.flatnonzero(out)


def polynomial_degree(x: np.ndarray, y: np.ndarray, legacy: bool = False) -> int:
    """The degree with the least root mean squared error over repeated folds; ties take the lowest. Degrees
    go up to min(n - 1, 10) over 5 folds, 3 times; in the older form up to n over 10 folds, 10 times."""
    n = len(x)
    if n < 3 and not legacy:
        return 1
    folds, repeats, top = (10, 10, n) if legacy else (min(5, n), 3, min(n - 1, 10))
    parts, best = list(repeated_folds(n, folds, repeats)), (math.inf, 1)
    for degree in range(1, top + 1):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            errors = [np.mean((np.poly1d(np.polyfit(x[rest], y[rest], degree))(x[out]) - y[out]) ** 2) for rest, out in parts]
        if (error := round(float(np.sqrt(np.mean(errors))), 12)) < best[0]:  # digits past that are the solver's
            best = (error, degree)
    return best[1]


def first_minimum(v: np.ndarray, legacy: bool = False) -> int | None:
    """The place of the first local minimum, ends included, or of the lowest value. The older form does
    not look at the last value."""
    for k in range(len(v)):
        last = k == len(v) - 1
        if (k == 0 or v[k] < v[k - 1]) and (last and (k == 0 or not legacy) or not last and v[k] < v[k + 1]):
            return k
    return int(np.argmin(v)) if len(v) else None


def bootstrap_width(p: np.ndarray, n_bar: int, statistic: str, n_boot: int, rng) -> float:
    """Distance of the 95 % and 5 % quantiles of a measure over n_boot samples of n_bar lines from the
    distribution p over bins. Bin k stands for length k + 1, as in the established tables; "legacy average"
    is the mean of all lines but the first, as the older average has it."""
    cdf = np.cumsum(p) / p.sum()
    draws = np.searchsorted(cdf, rng.random((n_boot, n_bar))) + 1
    if statistic == "percent":
        values = (draws > 1).mean(axis=1)
    elif statistic == "legacy average":
        values = draws[:, 1:].mean(axis=1) if n_bar > 1 else np.full(n_boot, math.nan)
    else:
        longer = draws > 1
        values = np.where(longer.any(axis=1), (draws * longer).sum(axis=1) / np.maximum(longer.sum(axis=1), 1), 0.0)
    return float(np.quantile(values, 0.95) - np.quantile(values, 0.05))
