"""Weak supervision on counted vote patterns: expectation-maximisation, and a classifier trained on its posteriors.

A pattern is a string with a character for each rule: 1 votes for the class, 0 against it, - abstains, which is a vote like
others, and ? means that the rule does not apply, which says nothing. There are at most 4 ** rules patterns, so all of this
runs on the driver on bounded input.
"""

from __future__ import annotations

import numpy as np


def votes_begin(right: np.ndarray) -> np.ndarray:
    """Starting table [class, rule, vote] of a bad and a good class, from how often each rule is taken to be right."""
    wrong = (1 - right) / 2
    return np.stack([np.stack([wrong, right, wrong], 1), np.stack([wrong, wrong, right], 1)])


def fit(patterns: dict[str, int], begin: np.ndarray, prior: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """EM over weighted vote patterns: share of each class, table [class, rule, vote], posterior of the last class by pattern.

    ``begin`` is the starting table, which also fixes what each class stands for, and counts as one vote of each rule in each
    class; ``prior`` the starting shares, which count as one item.
    """
    keys = sorted(patterns)
    table, share = begin / begin.sum(2, keepdims=True), prior / prior.sum()
    if not keys:
        return share, table, {}
    weight = np.array([patterns[k] for k in keys], float)
    vote = np.array([["-01?".index(c) for c in k] for k in keys])
    onehot = np.eye(4)[vote][:, :, :3]
    post = np.zeros((len(keys), len(share)))
    for _ in range(rounds):
        like = np.einsum("prv,crv->pc", onehot, np.log(table)) + np.log(share)
        like = np.exp(like - like.max(1, keepdims=True))
        old, post = post, like / like.sum(1, keepdims=True)
        if np.abs(post - old).max() < 1e-10:
            break
        held = weight[:, None] * post
        table = np.einsum("pc,prv->crv", held, onehot) + begin
        table /= table.sum(2, keepdims=True)
        share = (held.sum(0) + prior / prior.sum()) / (weight.sum() + 1)
    return share, table, dict(zip(keys, post[:, -1].tolist(), strict=True))


def classifier(patterns: dict[str, int], posterior: dict[str, float], rounds: int = 50, ridge: float = 1.0) -> dict[str, float]:
    """Logistic regression on the votes (one-hot), fitted to soft labels by Newton steps; its probability by pattern."""
    keys = sorted(patterns)
    if not keys:
        return {}
    vote = np.array([["-01?".index(c) for c in k] for k in keys])
    x = np.concatenate([np.ones((len(keys), 1)), np.eye(4)[vote][:, :, 1:3].reshape(len(keys), -1)], 1)
    weight, y = np.array([patterns[k] for k in keys], float), np.array([posterior[k] for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))).tolist(), strict=True))
