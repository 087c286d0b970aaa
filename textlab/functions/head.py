"""Loss, gradients and optimiser steps of a ReLU head on batches of vectors.

A head is a list of layers ``(weights[out, in], bias[out])`` with ReLU after every layer but
the last. One output is the logit of class 1; several outputs are one logit per class.
Sums over rows are kept apart from their weight, so that parts of a batch can be added up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

Layers = list[tuple[np.ndarray, np.ndarray]]

# Moments and stabiliser of the adaptive step, and the largest gradient norm.
BETAS, EPSILON, MAX_NORM = (0.9, 0.999), 1e-8, 1.0


def start_layers(widths: Sequence[int], seed: int) -> Layers:
    """Normal weights of deviation sqrt(2 / inputs), zero bias."""
    rng = np.random.default_rng(seed)
    return [(rng.normal(0.0, math.sqrt(2.0 / a), (b, a)), np.zeros(b)) for a, b in zip(widths, widths[1:])]


def keep_mask(keys: np.ndarray, units: int, rate: float, salt: int) -> np.ndarray:
    """Dropout factors per row and unit, 0 or 1 / (1 - rate). They depend on the row's key
    and the salt alone, so the layout of the table does not matter."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + np.uint64(salt % 2**64)
        x = _mix(x) + np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        u = (_mix(x) >> np.uint64(11)).astype(float) / 2**53
    return (u >= rate) / (1.0 - rate)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _forward(layers: Layers, x: np.ndarray, keep: np.ndarray | None) -> list[np.ndarray]:
    """Inputs of every layer and the logits; ``keep`` scales the last hidden layer."""
    steps = [x]
    for depth, (w, b) in enumerate(layers):
        x = x @ w.T + b
        if depth < len(layers) - 1:
            x = np.maximum(x, 0.0)
            if keep is not None and depth == len(layers) - 2:
                x = x * keep
        steps.append(x)
    return steps


def _row_losses(logits: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy of every row, its gradient by the logits, and the predicted class."""
    if logits.shape[1] == 1:
        z = logits[:, 0]
        loss = np.maximum(z, 0.0) - z * y + np.log1p(np.exp(-np.abs(z)))
        return loss, (0.5 * np.tanh(0.5 * z) + 0.5 - y)[:, None], (z > 0).astype(int)
    shifted = logits - logits.max(axis=1, keepdims=True)
    p = np.exp(shifted)
    total = p.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = np.log(total[:, 0]) - shifted[rows, y]
    slope = p / total
    slope[rows, y] -= 1.0
    return loss, slope, logits.argmax(axis=1)


def batch_sums(
    layers: Layers, x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int,
    keep: np.ndarray | None = None, gradients: bool = True,
) -> np.ndarray:
    """One vector of sums over the rows: weighted loss, weight, rows per (label, predicted
    class), and, if asked for, the gradients of the weighted loss layer by layer."""
    steps = _forward(layers, x, keep)
    loss, slope, predicted = _row_losses(steps[-1], y)
    cells = np.bincount(y * classes + predicted, minlength=classes * classes).astype(float)
    head = [np.array([(loss * weight).sum(), weight.sum()]), cells]
    if not gradients:
        return np.concatenate(head)
    slope = slope * weight[:, None]
    parts = []
    for depth in range(len(layers) - 1, -1, -1):
        parts += [slope.sum(axis=0), (slope.T @ steps[depth]).ravel()]
        if depth:
            slope = (slope @ layers[depth][0]) * (steps[depth] > 0)
            if keep is not None and depth == len(layers) - 1:
                slope = slope * keep
    return np.concatenate([*head, *parts[::-1]])


def gradient_layers(flat: np.ndarray, layers: Layers) -> Layers:
    """The gradient part of ``batch_sums`` in the shape of the layers."""
    out, at = [], 0
    for w, b in layers:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def with_penalty(gradient: Layers, layers: Layers, l1: float) -> tuple[Layers, float]:
    """Adds the gradient of ``l1`` times the absolute weights (no bias), and that sum."""
    if not l1:
        return gradient, 0.0
    total = l1 * sum(float(np.abs(w).sum()) for w, _ in layers)
    return [(g + l1 * np.sign(w), gb) for (g, gb), (w, _) in zip(gradient, layers)], total


def clipped(gradient: Layers, most: float = MAX_NORM) -> Layers:
    """The gradient scaled down to a norm of at most ``most``."""
    norm = math.sqrt(sum(float((g * g).sum()) for pair in gradient for g in pair))
    scale = min(1.0, most / (norm + 1e-6))
    return [(g * scale, b * scale) for g, b in gradient]


def plain_step(layers: Layers, gradient: Layers, rate: float, decay: float) -> Layers:
    """Gradient descent; the decay is part of the gradient."""
    return [(w - rate * (g + decay * w), b - rate * (gb + decay * b))
            for (w, b), (g, gb) in zip(layers, gradient)]


def adaptive_step(
    layers: Layers, gradient: Layers, first: Layers, second: Layers, step: int, rate: float, decay: float
) -> tuple[Layers, Layers, Layers]:
    """Adam with decoupled weight decay: new layers and both moments after step 1, 2, .."""
    b1, b2 = BETAS
    out, m_out, v_out = [], [], []
    for pair, g_pair, m_pair, v_pair in zip(layers, gradient, first, second):
        new, ms, vs = [], [], []
        for p, g, m, v in zip(pair, g_pair, m_pair, v_pair):
            m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
            scale = np.sqrt(v / (1 - b2**step)) + EPSILON
            new.append(p * (1 - rate * decay) - rate * (m / (1 - b1**step)) / scale)
            ms.append(m)
            vs.append(v)
        out.append(tuple(new))
        m_out.append(tuple(ms))
        v_out.append(tuple(vs))
    return out, m_out, v_out
