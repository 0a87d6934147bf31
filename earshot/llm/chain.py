"""Forward-backward over two-state chains, vectorised over documents of any length.

All documents of a batch are laid end to end. A document's first token has a transition matrix of equal
rows, which forgets what came before, so one long chain holds them all. The chain is cut into lanes whose
2x2 products are taken side by side, joined, and used to start each lane's exact recursion.
"""

from __future__ import annotations

import numpy as np


def marginals(odds: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray, pairs: bool = False):
    """P(state 1) of each token; with pairs, also the expected transitions and starts.

    odds: exp(score of state 1 - score of state 0) of each token; first: is it a document's first token;
    start[j], step[i, j]: positive weights.
    """
    n = len(odds)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    steps = max(1, int(np.sqrt(n) / 8))
    lanes = -(-n // steps)
    pad = lanes * steps - n

    def lay(x, fill):
        return np.ascontiguousarray(np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(lanes, steps).T)

    e, f = lay(odds, 1.0), lay(first, True)
    m00, m10 = np.where(f, start[0], step[0, 0]), np.where(f, start[0], step[1, 0])
    m01, m11 = np.where(f, start[1], step[0, 1]) * e, np.where(f, start[1], step[1, 1]) * e
    p00, p01, p10, p11 = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(steps):
        a, b, c, d = m00[t], m01[t], m10[t], m11[t]
        p00, p01, p10, p11 = p00 * a + p01 * c, p00 * b + p01 * d, p10 * a + p11 * c, p10 * b + p11 * d
        s = 1 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * s, p01 * s, p10 * s, p11 * s
    prods = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True))
    enter, x, y = [], 1.0, 0.0
    for a, b, c, d in prods:
        enter.append((x, y))
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    leave, x, y = [], 1.0, 1.0
    for a, b, c, d in reversed(prods):
        leave.append((x, y))
        x, y = a * x + b * y, c * x + d * y
        x, y = x / (x + y), y / (x + y)
    enter, leave = np.array(enter), np.array(leave[::-1])
    f0, f1 = np.empty((steps, lanes)), np.empty((steps, lanes))
    x, y = enter[:, 0], enter[:, 1]
    for t in range(steps):
        x, y = x * m00[t] + y * m10[t], x * m01[t] + y * m11[t]
        s = 1 / (x + y)
        f0[t], f1[t] = x, y = x * s, y * s
    b0, b1 = np.empty((steps, lanes)), np.empty((steps, lanes))
    x, y = leave[:, 0], leave[:, 1]
    for t in range(steps - 1, -1, -1):
        b0[t], b1[t] = x, y
        x, y = m00[t] * x + m01[t] * y, m10[t] * x + m11[t] * y
        s = 1 / (x + y)
        x, y = x * s, y * s
    one, both = f1 * b1, f0 * b0 + f1 * b1
    p = (one / both).T.reshape(-1)[:n]
    if not pairs:
        return p
    flat = [v.T.reshape(-1)[:n] for v in (f0, f1, b0, b1)]
    inner = np.flatnonzero(~first[1:]) + 1
    x0, x1, y0, y1 = flat[0][inner - 1], flat[1][inner - 1], flat[2][inner], flat[3][inner] * odds[inner]
    each = np.stack([x0 * step[0, 0] * y0, x0 * step[0, 1] * y1, x1 * step[1, 0] * y0, x1 * step[1, 1] * y1])
    return p, (each / each.sum(axis=0)).sum(axis=1).reshape(2, 2), np.array([(1 - p)[first].sum(), p[first].sum()])
