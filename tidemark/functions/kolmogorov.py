"""Two-sided p-value of the two-sample Kolmogorov-Smirnov statistic, on the driver."""

from __future__ import annotations

import math

import numpy as np

#: Up to this size of the larger sample the distribution is exact.
EXACT = 10_000


def exact_p(d: float, m: int, n: int) -> float:
    """Share of lattice paths from (0, 0) to (m, n) that reach |i/m - j/n| >= d.

    Walks the anti-diagonals with the probabilities of drawing without replacement; all comparisons are in integers.
    """
    g = math.gcd(m, n)
    lcm, step_i, step_j = m // g * n, n // g, m // g
    h = round(d * lcm)
    if h <= 0:
        return 1.0
    inside = np.zeros(m + 1)
    inside[0] = 1.0
    i = np.arange(m + 1)
    for k in range(1, m + n + 1):
        left = m + n - k + 1
        j = k - i
        # a step in i from (i - 1, j), or one in j from (i, j - 1)
        by_j = inside * np.clip(n - (j - 1), 0, None) / left
        by_i = np.zeros(m + 1)
        by_i[1:] = inside[:-1] * (m - i[:-1]) / left
        inside = np.where((j >= 0) & (j <= n) & (np.abs(i * step_i - j * step_j) < h), by_i + by_j, 0.0)
    return float(min(1.0, max(0.0, 1.0 - inside[m])))


def one_sample_cdf(n: int, d: float) -> float:
    """P(D_n < d), by the matrix power of Marsaglia, Tsang and Wang (2003)."""
    k = int(n * d) + 1
    size, h = 2 * k - 1, k - n * d
    i, j = np.indices((size, size))
    a = (i - j + 1 >= 0).astype(float)
    powers = h ** np.arange(1, size + 1)
    a[:, 0] -= powers
    a[-1, :] -= powers[::-1]
    if 2 * h - 1 > 0:
        a[-1, 0] += (2 * h - 1) ** size
    for r in range(size):
        for c in range(size):
            if r - c + 1 > 0:
                a[r, c] /= math.factorial(r - c + 1) if r - c + 1 <= 170 else math.inf
    result, base, e, e_result, e_base = np.eye(size), a, n, 0, 0
    while e:
        if e & 1:
            result, e_result = result @ base, e_result + e_base
        base, e_base, e = base @ base, 2 * e_base, e >> 1
        if base[k - 1, k - 1] > 1e140:
            base, e_base = base * 1e-140, e_base + 140
        if result[k - 1, k - 1] > 1e140:
            result, e_result = result * 1e-140, e_result + 140
    s = result[k - 1, k - 1]
    for x in range(1, n + 1):
        s *= x / n
        if s < 1e-140:
            s, e_result = s * 1e140, e_result - 140
    return min(1.0, max(0.0, s * 10.0**e_result))


def p_value(d: float, m: int, n: int) -> float:
    if max(m, n) <= EXACT:
        return exact_p(d, m, n)
    n_eff = round(m * n / (m + n))
    if n_eff <= 1000:
        return 1.0 - one_sample_cdf(n_eff, d)
    x = 2 * n_eff * d * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-x * k * k) for k in range(1, 101))))
