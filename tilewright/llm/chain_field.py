"""A linear-chain conditional random field over hashed features, in numpy: fitting and exact decoding.

Emissions are sums of rows of one weight table, a row for each feature of a token. `fit` climbs the
regularised log likelihood of padded windows by forward-backward. `viterbi` decodes any number of
chains laid end to end: steps are grouped in blocks, all blocks advance together as max-plus 3 x 3
products, a short loop joins the blocks, and a second sweep reads the labels, so its Python steps grow
with the block length and the number of blocks, not with their product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
N_TAGS = 3
NEVER = -1e4
BLOCK = 256


@dataclass
class Field:
    """weights (features + 1, 3): the last row is 0 and stands for a hidden feature; start (3); step (3, 3), from row to column."""

    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows (w, t, 3): each token's tag probabilities, the expected number of each transition, the log partition sums."""
    w, t, _ = emit.shape
    live = np.arange(t)[None, :] < lengths[:, None]
    ahead = np.empty_like(emit)
    ahead[:, 0] = start + emit[:, 0]
    for k in range(1, t):
        ahead[:, k] = np.where(live[:, k, None], _logsum(ahead[:, k - 1, :, None] + step, 1) + emit[:, k], ahead[:, k - 1])
    total = _logsum(ahead[:, -1], 1)
    back = np.zeros_like(emit)
    steps = np.zeros((N_TAGS, N_TAGS))
    for k in range(t - 2, -1, -1):
        onward = step + (emit[:, k + 1] + back[:, k + 1])[:, None, :]
        both = np.exp(ahead[:, k, :, None] + onward - total[:, None, None])
        steps += both[live[:, k + 1]].sum(0)
        back[:, k] = np.where(live[:, k + 1, None], _logsum(onward, 2), 0.0)
    return np.exp(ahead + back - total[:, None, None]) * live[:, :, None], steps, total


def fit(features: np.ndarray, tags: np.ndarray, lengths: np.ndarray, n_features: int, hideable: slice, rounds: int = 60, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Adam on the mean log likelihood. features (w, t, f): rows of the table; tags (w, t).

    Of every other window, now these, now those, the `hideable` features are hidden, so that the others
    must carry the decision alone too. The result depends on nothing but the arguments.
    """
    w, t, _ = features.shape
    live = np.arange(t)[None, :] < lengths[:, None]
    seen = np.eye(N_TAGS)[tags] * live[:, :, None]
    pairs = live[:, 1:]
    seen_steps = np.zeros((N_TAGS, N_TAGS))
    np.add.at(seen_steps, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    seen_start = np.bincount(tags[:, 0], minlength=N_TAGS)
    barred = np.zeros((N_TAGS, N_TAGS))
    barred[OUTSIDE, INSIDE] = NEVER
    barred_start = np.array([0.0, 0.0, NEVER])
    params = [np.zeros((n_features + 1, N_TAGS)), np.zeros(N_TAGS), np.zeros((N_TAGS, N_TAGS))]
    means = [np.zeros_like(p) for p in params]
    squares = [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        used = features.copy()
        used[r % 2 :: 2, :, hideable] = n_features
        weights, start, step = params
        emit = weights[used].sum(2)
        probable, steps, _ = marginals(emit, lengths, start + barred_start, step + barred)
        off = (seen - probable)[:, :, None, :] / w
        slopes = [np.stack([np.bincount(used.ravel(), np.broadcast_to(off[..., k], used.shape).ravel(), n_features + 1) for k in range(N_TAGS)], 1)]
        slopes += [(seen_start - probable[:, 0].sum(0)) / w, (seen_steps - steps) / w]
        slopes[0][-1] = 0
        for p, g, m, v in zip(params, slopes, means, squares, strict=True):
            g = g - ridge / w * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    weights, start, step = params
    weights[-1] = 0
    return Field(weights.astype(np.float32), start + barred_start, step + barred)


def viterbi(emit: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The best tags of chains laid end to end: emit (n, 3), first (n) true where a chain begins. Ties take the lower tag."""
    n = len(emit)
    if not n:
        return np.zeros(0, np.uint8)
    n_blocks = -(-n // block)
    rows = np.zeros((n_blocks * block, N_TAGS))
    rows[:n] = emit
    begins = np.ones(n_blocks * block, bool)
    begins[:n] = first
    begins[0] = True
    rows, begins = rows.reshape(n_blocks, block, N_TAGS).swapaxes(0, 1), begins.reshape(n_blocks, block).T

    def arcs(k: int) -> np.ndarray:  # (blocks, from, to)
        return np.where(begins[k][:, None, None], start[None, None, :], step[None]) + rows[k][:, None, :]

    across = arcs(0)
    for k in range(1, block):
        across = (across[:, :, :, None] + arcs(k)[:, None, :, :]).max(2)
    enter = np.empty((n_blocks, N_TAGS))
    at = np.zeros(N_TAGS)
    for b in range(n_blocks):
        enter[b] = at
        at = (at[:, None] + across[b]).max(0)
        at -= at.max()
    came = np.empty((block, n_blocks, N_TAGS), np.uint8)
    best = enter
    for k in range(block):
        ways = best[:, :, None] + arcs(k)
        came[k] = ways.argmax(1)
        best = ways.max(1)
    path = np.empty((block, n_blocks, N_TAGS), np.uint8)  # the tag at each step for each tag after the block's last step
    tag = np.broadcast_to(np.arange(N_TAGS, dtype=np.uint8), (n_blocks, N_TAGS))
    for k in range(block - 1, -1, -1):
        path[k] = tag
        tag = np.take_along_axis(came[k], tag, 1)
    last = np.empty(n_blocks, np.uint8)
    now = int(best[-1].argmax())
    for b in range(n_blocks - 1, -1, -1):
        last[b] = now
        now = int(tag[b, now])
    return np.take_along_axis(path, np.broadcast_to(last[None, :, None], (block, n_blocks, 1)), 2)[:, :, 0].T.reshape(-1)[:n]
