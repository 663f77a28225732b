"""Bounded nonlinear least squares of seasonal models, a batch of series at a time.

SciPy is not needed: damped Gauss-Newton steps are solved for all series of a batch at once and projected
into the bounds. The fit is the only step that leaves the JVM; series come as arrays, one row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonspark.functions.waveforms import floored, holds_first, meetings, tooth
from seasonspark.operators.series import recentred, to_arrays
from seasonspark.operators.stats import first_peak

INF = np.inf
BATCH = 512


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _double_logistic(t, p):
    xs, ss, xa, sa, bias, scale = (p[:, i : i + 1] for i in range(6))
    return bias + scale * (_sigmoid((t - xs) / ss) - _sigmoid((t - xa) / sa))


def _mod(x, period):
    # Not np.mod: with the roundings of the columns a sample at a jump falls on the same side there.
    return floored(x, period, np.floor)


def _double_logistic_wrapped(t, p):
    xs, ss, xa, sa, bias, scale = (p[:, i : i + 1] for i in range(6))
    return bias + scale * (_sigmoid(-_mod(t - xs, 365.0) / ss) - _sigmoid(-_mod(t - xa, 365.0) / sa))


def _tanh_sine(t, p):
    phase, bias, scale, k = (p[:, i : i + 1] for i in range(4))
    return bias + scale * np.tanh(k * np.sin(2 * np.pi * (t - phase) / 365)) / np.where(k == 0, 1, np.tanh(np.where(k == 0, 1, k)))


def _sigmoid_sine(t, p):
    return p[:, :1] * (2 * _sigmoid(p[:, 1:2] * np.sin(t)) - 1)


def _cyclic_gaussian(t, p):
    a, mu, sigma, c = (p[:, i : i + 1] for i in range(4))
    sigma = np.where(np.abs(sigma) < 1e-9, 1e-9, sigma)
    return c + a * np.exp(-0.5 * np.minimum(((_mod(t - mu + 182.5, 365.0) - 182.5) / sigma) ** 2, 1400))


def _divide(x, y):
    return np.divide(x, y, out=np.full(np.broadcast(x, y).shape, np.nan), where=y != 0)


def _sawtooth(t, p):
    z1, d1, z2, d2, bias, scale = (p[:, i : i + 1] for i in range(6))
    m1, m2 = (1 / np.where(np.abs(d) < 1e-9, 1e-9, d) for d in (d1, d2))
    z1, z2 = _mod(z1, 365.0), _mod(z2, 365.0)
    both, (a, b) = meetings(_mod(z1, 365.0), m1, _mod(z2, 365.0), m2, 365.0, _mod, _divide)
    first, second = np.where(both, np.fmin(a, b), 0.0), np.where(both, np.fmax(a, b), 182.5)
    on_first = holds_first(_mod(t, 365.0), first, second, z1, m1, 365.0, _mod)
    z, m = np.where(on_first, z1, z2), np.where(on_first, m1, m2)
    return bias + scale * _sigmoid(tooth(t, z, 365.0, _mod) * m)


# The starts and bounds of each model.


def _guess_double_logistic(t, y):
    low, span = y.min(), np.ptp(y)
    return [(120, 20, 270, 25, low, span), (240, 20, 60, 25, low + span, span), (240, 20, 60, 25, low + span / 2, 1), (120, 20, 270, 25, low + span / 2, 1)]


@dataclass(frozen=True)
class Model:
    """A curve, its parameters with bounds, and the starts of the search given a series."""

    names: tuple[str, ...]
    curve: Callable[[np.ndarray, np.ndarray], np.ndarray]
    low: tuple[float, ...]
    high: tuple[float, ...]
    starts: Callable[[np.ndarray, np.ndarray], Sequence[Sequence[float]]]
    #: Name of a parameter that is an angle in days and is returned modulo 365.
    cyclic: str | None = None
    #: Places of an offset and a factor in which the curve is linear.
    linear: tuple[int, int] | None = (4, 5)


_DL = ("xmid_s", "scal_s", "xmid_a", "scal_a", "bias", "scale")
_ST = ("z1", "d1", "z2", "d2", "bias", "scale")
_FREE = (-INF,) * 6
_single = lambda t, y: _guess_double_logistic(t, y)[:1]
_peak = lambda t, y: [(np.ptp(y), t[np.argmax(y)], w, y.min()) for w in (30, 90)] + [(np.ptp(y) / 2, 182, 60, y.mean())]

# Widths of less than a thousandth of a day would be steps or spikes and are kept off.
MODELS = {
    "double_logistic": Model(_DL, _double_logistic, (0, 1e-5, 0, 1e-5, -INF, 1e-5), (365, INF, 365, INF, INF, INF), _guess_double_logistic),
    "double_logistic_free": Model(_DL, _double_logistic, _FREE, (INF,) * 6, _single),
    "double_logistic_sample": Model(_DL, _double_logistic, (0, 1, 180, 1, -2000, 0), (365, 200, 365, 200, 12000, 20000), lambda t, y: [(120, 20, 270, 20, 1000, 7000), (40, 2, 340, 10, 2000, 6000), (90, 1.2, 350, 3, 2600, 5000)]),
    "double_logistic_wrapped": Model(_DL, _double_logistic_wrapped, _FREE, (INF,) * 6, _single),
    "tanh_sine": Model(("phase", "bias", "scale", "sharpness"), _tanh_sine, (0, 0, 0, 0.1), (365, 8000, 20000, 50), lambda t, y: [(120, 3000, 4000, 5)], linear=(1, 2)),
    "sigmoid_sine": Model(("amplitude", "steepness"), _sigmoid_sine, (-INF, -INF), (INF, INF), lambda t, y: [(1, 1)], linear=None),
    "cyclic_gaussian": Model(("a", "mu", "sigma", "c"), _cyclic_gaussian, (0, 0, 1e-3, -INF), (INF, 365, 365, INF), _peak, "mu", (3, 0)),
    "cyclic_gaussian_point": Model(("a", "mu", "sigma", "c"), _cyclic_gaussian, (0, -365, 1e-3, -INF), (INF, 365, 365, INF), _peak, "mu", (3, 0)),
    "sawtooth": Model(_ST, _sawtooth, (-INF, 1e-3, -INF, -INF, -INF, 1e-5), (INF, INF, INF, -1e-3, INF, INF), lambda t, y: [(100, 50, 250, -50, y.mean(), np.ptp(y))]),
}


def solve(model: Model, t: np.ndarray, y: np.ndarray, used: np.ndarray, start: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and squared errors of a batch: ``t, y, used`` are (series, samples), ``start`` (series, parameters).

    A start is moved into the bounds. Steps that do not lower the error are damped ten times more.
    """
    low, high = np.array(model.low, float), np.array(model.high, float)
    p = np.clip(start, low, high)

    def errors(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.where(used, y - model.curve(t, q), 0.0)
        sse = (r * r).sum(1)
        return r, np.where(np.isfinite(sse), sse, INF)

    _, sse = errors(p)
    damping, live = np.full(len(p), 1e-3), sse > 1e-20
    every_t, every_y, every_used = t, y, used
    for _ in range(rounds):
        at = np.flatnonzero(live)
        if not len(at):
            break
        t, y, used, q0, old = every_t[at], every_y[at], every_used[at], p[at], sse[at]
        r, _ = errors(q0)
        base = model.curve(t, q0)
        jac = np.empty((*t.shape, p.shape[1]))
        for k in range(p.shape[1]):
            h = 1e-6 * np.maximum(np.abs(q0[:, k]), 1e-2)
            h = np.where(q0[:, k] + h > high[k], -h, h)
            q = q0.copy()
            q[:, k] += h
            jac[:, :, k] = (model.curve(t, q) - base) / h[:, None] * used
        jac = np.nan_to_num(jac, posinf=0.0, neginf=0.0)
        gradient = np.einsum("btk,bt->bk", jac, r)
        stuck = ((q0 <= low) & (gradient < 0)) | ((q0 >= high) & (gradient > 0))
        jac = np.where(stuck[:, None, :], 0.0, jac)
        gradient = np.where(stuck, 0.0, gradient)
        normal = np.matmul(jac.transpose(0, 2, 1), jac)
        diagonal = np.einsum("bkk->bk", normal)
        scale = np.maximum(diagonal, 1e-12 * np.maximum(diagonal.max(1, keepdims=True), 1e-300))
        system = normal + (damping[at, None] * scale)[:, :, None] * np.eye(p.shape[1])
        step = np.linalg.solve(system + 1e-300 * np.eye(p.shape[1]), gradient[:, :, None])[:, :, 0]
        tried = np.clip(q0 + np.where(np.isfinite(step), step, 0.0), low, high)
        _, new = errors(tried)
        better = new < old
        p[at] = np.where(better[:, None], tried, q0)
        sse[at] = np.where(better, new, old)
        small = better & (old - new <= 1e-9 * np.maximum(old, 1e-300)) & (damping[at] <= 1e-2)
        stalled = ~better & (damping[at] > 1e9)
        damping[at] = np.where(better, np.maximum(damping[at] / 10, 1e-12), damping[at] * 10)
        live[at] = ~(small | stalled) & (sse[at] > 1e-20)
    return p, sse


def _sse(model: Model, t: np.ndarray, y: np.ndarray, used: np.ndarray, p: np.ndarray) -> np.ndarray:
    r = np.where(used, y - model.curve(t, p), 0.0)
    sse = (r * r).sum(1)
    return np.where(np.isfinite(sse), sse, INF)


def _level(model: Model, t: np.ndarray, y: np.ndarray, used: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``p`` with the offset and factor that fit its shape best within the bounds, where that lowers the error."""
    if model.linear is None:
        return p
    offset, factor = model.linear
    p = np.clip(p, model.low, model.high)
    q = p.copy()
    q[:, offset], q[:, factor] = 0.0, 1.0
    n, shape = used.sum(1), np.where(used, model.curve(t, q), 0.0)
    mean_x, mean_y = shape.sum(1) / n, np.where(used, y, 0.0).sum(1) / n
    x, z = np.where(used, shape - mean_x[:, None], 0.0), np.where(used, y - mean_y[:, None], 0.0)
    power = (x * x).sum(1)
    slope = np.divide((x * z).sum(1), power, out=np.zeros(len(p)), where=power > 0)
    q[:, factor] = np.clip(slope, model.low[factor], model.high[factor])
    q[:, offset] = np.clip(mean_y - q[:, factor] * mean_x, model.low[offset], model.high[offset])
    return np.where((_sse(model, t, y, used, q) < _sse(model, t, y, used, p))[:, None], q, p)


def _nudged(model: Model, t: np.ndarray, y: np.ndarray, used: np.ndarray, p: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Steps along single parameters, where a bound or a kink holds the joint step up."""
    p = _level(model, t, y, used, p)
    sse = _sse(model, t, y, used, p)
    for _ in range(rounds):
        before = sse.copy()
        for k in range(p.shape[1]):
            for step in (-0.1, 0.1, -0.01, 0.01):
                q = p.copy()
                q[:, k] = np.clip(q[:, k] + step * np.maximum(np.abs(q[:, k]), 1e-6), model.low[k], model.high[k])
                new = _sse(model, t, y, used, q)
                better = new < sse
                p, sse = np.where(better[:, None], q, p), np.where(better, new, sse)
        if not (sse < before * (1 - 1e-4)).any():
            break
    return p, sse


def settle(model: Model, t: np.ndarray, y: np.ndarray, used: np.ndarray, start: np.ndarray, turns: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """``solve``, and again from where the best offset and factor or single steps still lower the error by more than 1e-4."""
    p, sse = solve(model, t, y, used, start)
    open_ = np.arange(len(p))
    for _ in range(turns):
        q, new = _nudged(model, t[open_], y[open_], used[open_], p[open_])
        moved = new < sse[open_] * (1 - 1e-4)
        p[open_], sse[open_] = q, new
        open_ = open_[moved]
        if not len(open_):
            break
        q, new = solve(model, t[open_], y[open_], used[open_], p[open_])
        better = new < sse[open_]
        p[open_[better]], sse[open_[better]] = q[better], new[better]
    return p, sse


def covariance_quality(model: Model, t: np.ndarray, p: np.ndarray, sse: float) -> float:
    """Mean standard error of the parameters of one fit; infinite if they are not determined."""
    steps = 1e-6 * np.maximum(np.abs(p), 1e-2)
    base = model.curve(t[None], p[None])[0]
    jac = np.stack([(model.curve(t[None], (p + h * e)[None])[0] - base) / h for h, e in zip(steps, np.eye(len(p)), strict=True)], 1)
    if len(t) <= len(p):
        return INF
    try:
        variance = np.diag(np.linalg.inv(jac.T @ jac)) * sse / (len(t) - len(p))
    except np.linalg.LinAlgError:
        return INF
    return float(np.sqrt(variance).mean()) if (variance >= 0).all() else INF


def fit_batch(model: Model, series: list[tuple[np.ndarray, np.ndarray]], least: int) -> list[dict | None]:
    """Best of all starts per series, the earliest on ties; None below ``least`` samples, status in the rest."""
    out: list[dict | None] = [None] * len(series)
    todo = []
    for i, (t, y) in enumerate(series):
        if len(y) >= max(1, least):
            if np.ptp(y) == 0:
                out[i] = {"status": "degenerate"}
            else:
                todo.append(i)
    if not todo:
        return out
    width = max(len(series[i][0]) for i in todo)
    t, y, used = (np.zeros((len(todo), width), k) for k in (float, float, bool))
    for row, i in enumerate(todo):
        n = len(series[i][0])
        t[row, :n], y[row, :n], used[row, :n] = series[i][0], series[i][1], True
    starts = [model.starts(*series[i]) for i in todo]
    best, error = None, None
    for k in range(len(starts[0])):
        p, sse = settle(model, t, y, used, np.array([s[k] for s in starts], float))
        if best is None:
            best, error = p, sse
        else:
            better = sse < error * (1 - 1e-9)
            best, error = np.where(better[:, None], p, best), np.where(better, sse, error)
    for row, i in enumerate(todo):
        ti, yi = series[i]
        if not np.isfinite(error[row]):
            out[i] = {"status": "failed"}
            continue
        p = best[row].copy()
        fitted = model.curve(ti[None], p[None])[0]
        total = ((yi - yi.mean()) ** 2).sum()
        spread = fitted.std()
        pearson = float(np.corrcoef(yi, fitted)[0, 1] ** 2) if len(yi) >= 5 and spread > 1e-9 * max(1.0, abs(fitted).max()) else None
        quality = covariance_quality(model, ti, p, error[row])
        if model.cyclic:
            p[model.names.index(model.cyclic)] %= 365
        out[i] = {"status": "ok", "params": p, "r2": pearson, "r2_sse": float(1 - error[row] / total) if total else None, "cov_quality": quality, "sse": float(error[row])}
    return out


def fit(series: DataFrame, keys: Sequence[str], model: str | Model, *, obs: str = "obs", t: str = "doy", y: str = "value", least: int = 1) -> DataFrame:
    """``keys, <parameters>, r2, r2_sse, cov_quality, sse, status`` for every series, one row each.

    ``series`` has an array of structs ``obs`` per row. Null and non-finite samples do not count. ``status``:
    ok, few (below ``least`` samples), degenerate (constant), failed; parameters are null but for ok.
    Series are fit in batches of a bounded number, whatever the keys.
    """
    model = MODELS[model] if isinstance(model, str) else model
    pair = F.transform(F.col(obs), lambda o: F.struct(o[t].cast("double").alias("t"), o[y].cast("double").alias("y")))
    good = F.filter(pair, lambda o: o.t.isNotNull() & o.y.isNotNull() & (F.abs(o.y) < float("inf")))
    rows = series.select(*keys, F.transform(good, lambda o: o.t).alias("_t"), F.transform(good, lambda o: o.y).alias("_y"))
    doubles = [*model.names, "r2", "r2_sse", "cov_quality", "sse"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.slice(at, BATCH)
                ts, ys = ([np.array(v.as_py() or [], float) for v in batch.column(c)] for c in ("_t", "_y"))
                found = fit_batch(model, list(zip(ts, ys, strict=True)), least)
                columns: dict[str, list] = {c: [] for c in doubles}
                status = []
                for f in found:
                    ok = f is not None and f["status"] == "ok"
                    status.append("few" if f is None else f["status"])
                    for k, c in enumerate(model.names):
                        columns[c].append(float(f["params"][k]) if ok else None)
                    for c in doubles[len(model.names) :]:
                        columns[c].append(f[c] if ok else None)
                arrays = [batch.column(k) for k in keys] + [pa.array(columns[c], pa.float64()) for c in doubles] + [pa.array(status, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *doubles, "status"])

    types = dict(rows.dtypes)
    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"`{c}` double" for c in doubles), "status string"])
    return rows.mapInArrow(run, ddl)


def peak_centred(df: DataFrame, keys: Sequence[str], *, doy: str = "doy", value: str = "filtered", seq: Column | str = "seq") -> DataFrame:
    """Adds ``peak``, the day of the highest sample, and turns the days so that it lies mid-year; the samples are ``value``."""
    peaks = df.groupBy(*keys).agg(first_peak(F.col(value), F.col(doy), F.col(seq) if isinstance(seq, str) else seq).alias("peak"))
    return df.join(peaks, list(keys)).withColumn("doy", recentred(F.col(doy), F.col("peak"))).withColumn("value", F.col(value))


def fit_peak_centred(df: DataFrame, keys: Sequence[str], *, doy: str = "doy", value: str = "filtered", seq: Column | str = "seq") -> DataFrame:
    """Double logistic of the ``peak_centred`` samples; ``peak`` undoes the turn."""
    turned = peak_centred(df, keys, doy=doy, value=value, seq=seq)
    return fit(to_arrays(turned, [*keys, "peak"], ["doy", "value"]), [*keys, "peak"], "double_logistic_free")
