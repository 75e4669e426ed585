"""Hashed text features of whole texts and small linear models in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from claimweave.llm.words import sums, words

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[: 0x30] = 32
_FOLD[0x30:0x41] = 32
_FOLD[0x5B:0x61] = 32
_FOLD[0x7B:0x80] = 32
_PLAIN = np.arange(256, dtype=np.uint8)


def grams(texts: pa.Array, buckets: int, letters_only: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, first)``: hashed byte trigrams of every text, of lower-case letters only or of all bytes."""
    batch = words(texts)
    raw = (_FOLD if letters_only else _PLAIN)[batch.raw].astype(np.uint32)
    n = len(raw)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(batch.begin), np.int64)
    code = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code ^= code >> np.uint32(13)
    ids = (code % np.uint32(buckets)).astype(np.int64)
    # A gram belongs to the text of its first byte; those that reach into the next text end in its first byte only.
    blank = (raw[:-2] == 32) & (raw[1:-1] == 32)
    keep = ~blank
    before = np.concatenate([[0], np.cumsum(keep)])
    first = before[np.minimum(batch.begin, n - 2)]
    return ids[keep], first


def histograms(texts: pa.Array, buckets: int, letters_only: bool = True) -> np.ndarray:
    """Relative frequencies of the grams of every text."""
    ids, first = grams(texts, buckets, letters_only)
    count = len(first) - 1
    owner = np.repeat(np.arange(count), np.diff(first))
    flat = np.bincount(owner * buckets + ids[: first[-1]], minlength=count * buckets).reshape(count, buckets)
    return flat / np.maximum(flat.sum(axis=1, keepdims=True), 1)


def mean_scores(texts: pa.Array, weights: np.ndarray, letters_only: bool = True) -> np.ndarray:
    """``histograms(texts) @ weights`` without the histograms; ``weights`` is buckets x models."""
    ids, first = grams(texts, len(weights), letters_only)
    sizes = np.maximum(np.diff(first), 1)
    return np.stack([sums(weights[:, m][ids], first) / sizes for m in range(weights.shape[1])], axis=1)


def linear_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, turns: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine for labels -1 and 1; classes weigh alike.

    Full sub-gradient steps of the hinge loss with a shrinking step, averaged over the last half.
    """
    spread = x.std(axis=0) + 0.1 * x.std() + 1e-12
    center = x.mean(axis=0)
    z = (x - center) / spread / np.sqrt(x.shape[1])
    cost = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, b = np.zeros(x.shape[1]), 0.0
    total_w, total_b, kept = np.zeros(x.shape[1]), 0.0, 0
    for turn in range(turns):
        step = 20.0 / (1.0 + 0.02 * turn)
        wrong = y * (z @ w + b) < 1
        pull = cost * y * wrong
        w += step * (z.T @ pull - strength * w)
        b += 0.1 * step * pull.sum()
        if turn >= turns // 2:
            total_w, total_b, kept = total_w + w, total_b + b, kept + 1
    w, b = total_w / kept / spread / np.sqrt(x.shape[1]), total_b / kept
    return w, float(b - center @ w)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, strength: float = 1e-3, turns: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression for labels 0 and 1."""
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12)
    spread = x.std(axis=0) + 0.1 * x.std() + 1e-12
    center = x.mean(axis=0)
    z = (x - center) / spread / np.sqrt(x.shape[1])
    w, b = np.zeros(x.shape[1]), 0.0
    for turn in range(turns):
        step = 40.0 / (1.0 + 0.01 * turn)
        error = weight * (y - sigmoid(z @ w + b))
        w += step * (z.T @ error - strength * w)
        b += 0.1 * step * error.sum()
    w = w / spread / np.sqrt(x.shape[1])
    return w, float(b - center @ w)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
