"""Recursive per-bar kernels (NumPy / pandas) run by :func:`barloom.operators.blocks.kernel` on one bounded block at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd


def ewm(x, alpha: float, min_periods: int = 1) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=min_periods).mean().to_numpy()


def ema(x, span: int, min_periods: int = 1) -> np.ndarray:
    return ewm(x, 2.0 / (span + 1.0), min_periods)


def rsi(close, n: int = 14) -> np.ndarray:
    """Wilder RSI; no losses gives null."""
    d = np.diff(np.asarray(close, float), prepend=np.nan)
    up, down = np.where(np.isnan(d), np.nan, np.maximum(d, 0)), np.where(np.isnan(d), np.nan, np.maximum(-d, 0))
    gain, loss = ewm(up, 1.0 / n, n), ewm(down, 1.0 / n, n)
    with np.errstate(all="ignore"):
        return 100 - 100 / (1 + gain / np.where(loss == 0, np.nan, loss))


def true_range(pdf) -> np.ndarray:
    prev = pdf["close"].shift(1)
    return pd.concat([pdf["high"] - pdf["low"], (pdf["high"] - prev).abs(), (pdf["low"] - prev).abs()], axis=1).max(axis=1).to_numpy()


def smooth(pdf) -> dict[str, np.ndarray]:
    """Exponential averages, MACD and RSI of the close."""
    x = pdf["close"].to_numpy(float)
    line = ema(x, 12) - ema(x, 26)
    return {"ema_8": ema(x, 8), "ema_21": ema(x, 21), "ema_50": ema(x, 50), "ema_200": ema(x, 200),
            "macd_line": line, "macd_signal": ema(line, 9), "rsi_14": rsi(x)}


SMOOTH = "ema_8 double, ema_21 double, ema_50 double, ema_200 double, macd_line double, macd_signal double, rsi_14 double"


def wilder_atr(n: int = 14):
    return lambda pdf: {"satr": ewm(true_range(pdf), 1.0 / n, n)}


def adaptive(close, before, weight, state):
    """Average that moves to each close by the bar's weight, from the close before the first weighted bar on."""
    out, last = np.full(len(close), np.nan), state[0]
    for i, (x, prev, w) in enumerate(zip(close, before, weight)):
        if w == w:
            last = prev if last != last else last
            out[i] = last = last + w * (x - last)
    return out, [last]


def parabolic(bars, state, step: float = 0.02, top: float = 0.2):
    """Parabolic stop and trend (+1 / -1). ``bars``: high, low and the highs and lows of the two bars before; state: side, factor, extreme, stop."""
    side, factor, extreme, stop = state
    stops, sides = [], []
    for high, low, h1, h2, l1, l2 in bars:
        if side != side:  # first bar
            side, factor, extreme, stop = 1.0, step, high, low
        else:
            stop += factor * (extreme - stop)
            near = [x for x in ((l1, l2) if side > 0 else (h1, h2)) if x == x]
            stop = min(stop, *near) if side > 0 else max(stop, *near)
            far, back = (high, low) if side > 0 else (low, high)
            if side * (back - stop) < 0:
                side, stop, extreme, factor = -side, extreme, back, step
            elif side * (far - extreme) > 0:
                extreme, factor = far, min(factor + step, top)
        stops.append(stop)
        sides.append(int(side))
    return stops, sides, [side, factor, extreme, stop]


def cusum(close, threshold, before, state):
    """Symmetric log-return CUSUM: both sums reset when either side reaches the bar's threshold (+1 up, -1 down); a bar without a positive
    threshold is passed over. ``before`` is the close of the bar before; returns the signs and the sums left at the end."""
    thr = np.asarray(threshold, float)
    with np.errstate(all="ignore"):
        step = np.log(np.asarray(close, float) / np.asarray(before, float))
    out = np.zeros(len(thr), int)
    pos, neg = state
    for i in np.flatnonzero((thr > 0) & np.isfinite(step)).tolist():
        pos, neg = max(0.0, pos + step[i]), min(0.0, neg + step[i])
        if pos >= thr[i] or neg <= -thr[i]:
            out[i] = 1 if pos >= thr[i] else -1
            pos = neg = 0.0
    return out, [pos, neg]
