"""Robust statistics of trends."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

# Coefficients of the rational approximation 7.1.26 of erf (Abramowitz and Stegun).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: float) -> float:
    u = 1 / (1 + ERF_P * abs(x))
    poly = u * (ERF_A[0] + u * (ERF_A[1] + u * (ERF_A[2] + u * (ERF_A[3] + u * ERF_A[4]))))
    return math.copysign(1 - poly * math.exp(-x * x), x)


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def trend(t: np.ndarray, y: np.ndarray, block: int = 256) -> dict:
    """Mann-Kendall S with tie-corrected variance, p-value, and the Theil-Sen slope (upper median); samples in time order."""
    n = len(t)
    s, slopes = 0, []
    for a in range(0, n - 1, block):
        b = min(a + block, n - 1)
        dy = y[None, :] - y[a:b, None]
        dt = t[None, :] - t[a:b, None]
        later = np.arange(n)[None, :] > np.arange(a, b)[:, None]
        s += int(np.sign(dy[later]).sum())
        use = later & (dt != 0)
        slopes.append(dy[use] / dt[use])
    _, ties = np.unique(y, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - float(sum(k * (k - 1) * (2 * k + 5) for k in ties.tolist() if k > 1))) / 18
    if var <= 0:
        return {"s": s, "z": None, "p": None, "slope": None}
    z = (s - np.sign(s)) / math.sqrt(var)
    every = np.concatenate(slopes) if slopes else np.array([])
    slope = float(np.partition(every, len(every) // 2)[len(every) // 2]) if len(every) else 0.0
    return {"s": s, "z": float(z), "p": 2 * (1 - normal_cdf(abs(z))), "slope": slope}


def trend_frame(rows: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: columns log_id, t_us, seq, mb."""
    rows = rows.sort_values(["t_us", "seq"])
    got = trend(rows["t_us"].to_numpy(float) / 1e6, rows["mb"].to_numpy(float))
    slope = got["slope"] * 3600 if got["slope"] is not None else None
    return pd.DataFrame([[rows["log_id"].iloc[0], len(rows), got["s"], got["z"], got["p"], slope]], columns=["log_id", "n", "s", "z", "p", "mb_per_hour"])
