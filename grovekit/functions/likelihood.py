"""Likelihood of sequences under one hidden master sequence with inserts, deletions and substitutions: the model that ``operators.masters`` fits.

Before each master token a run of inserts is drawn (each goes on with ``p_ins``, tokens from the background), then the token is
left out with ``p_del`` or emitted: itself with 1 - ``eps``, else a background token. A last run of inserts ends the observation. With
eps = 0 this is the simple model, in which an emitted token must match. Tokens are any hashable values.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Hashable, Sequence
from dataclasses import dataclass, field

import numpy as np

Tokens = Sequence[Hashable]
LOWEST, HIGHEST = 1e-4, 0.95


def _log(x: float) -> float:
    return math.log(x) if x > 0 else -math.inf


@dataclass(frozen=True)
class Background:
    """Token shares smoothed by ``pseudo`` counts; an unknown token has the share of one pseudo count."""

    share: dict = field(default_factory=dict)
    unknown: float = 1e-9

    @classmethod
    def fit(cls, sequences: Sequence[Tokens], pseudo: float = 0.5, alphabet: Sequence[Hashable] = ()) -> Background:
        counts = Counter(t for s in sequences for t in s)
        tokens = list(dict.fromkeys([*alphabet, *counts]))
        total = sum(counts.values()) + pseudo * len(tokens)
        return cls({t: (counts[t] + pseudo) / total for t in tokens}, pseudo / total) if tokens else cls()

    def of(self, token: Hashable) -> float:
        return self.share.get(token, self.unknown)

    def draw(self, rng: np.random.Generator) -> Hashable:
        tokens = list(self.share)
        return tokens[int(rng.choice(len(tokens), p=np.array(list(self.share.values())) / sum(self.share.values())))]


@dataclass(frozen=True)
class Indel:
    background: Background
    p_ins: float = 0.1
    p_del: float = 0.1
    eps: float = 0.05

    def emission(self, token: Hashable, master: Hashable) -> float:
        """Natural logarithm."""
        return _log((1 - self.eps) * (token == master) + self.eps * self.background.of(token))

    def _steps(self, master: Tokens, seen: Tokens):
        insert = np.array([_log(self.p_ins) + _log(self.background.of(t)) for t in seen])
        emit = np.array([[self.emission(t, m) for t in seen] for m in master]).reshape(len(master), len(seen))
        return insert, _log(1 - self.p_ins) + _log(self.p_del), _log(1 - self.p_ins) + _log(1 - self.p_del) + emit

    def loglik(self, master: Tokens, seen: Tokens) -> float:
        """Sum over all alignments; rows are master places, columns tokens seen."""
        insert, skip, emit = self._steps(master, seen)
        row = np.concatenate(([0.0], np.cumsum(insert)))
        for i in range(len(master)):
            entered = row + skip
            entered[1:] = np.logaddexp(entered[1:], row[:-1] + emit[i])
            row = entered.copy()
            for j in range(len(seen)):
                row[j + 1] = np.logaddexp(entered[j + 1], row[j] + insert[j])
        return float(row[-1] + _log(1 - self.p_ins))

    def total(self, master: Tokens, sequences: Sequence[Tokens], weights: Sequence[float] | None = None) -> float:
        return float(sum(w * self.loglik(master, s) for s, w in zip(sequences, weights or [1.0] * len(sequences), strict=True)))

    def best_alignment(self, master: Tokens, seen: Tokens) -> tuple[float, list[tuple[str, int | None, int | None]]]:
        """(log probability, steps) of the likeliest alignment: ("M", master place, token place), ("D", place, None), ("I", None, place)."""
        insert, skip, emit = self._steps(master, seen)
        n, m = len(master), len(seen)
        score, how = np.full((n + 1, m + 1), -np.inf), np.full((n + 1, m + 1), "", dtype="<U1")
        score[0, 0] = 0.0
        for i in range(n + 1):
            for j in range(m + 1):
                options = [("M", score[i - 1, j - 1] + emit[i - 1, j - 1])] if i and j else []
                options += [("D", score[i - 1, j] + skip)] if i else []
                options += [("I", score[i, j - 1] + insert[j - 1])] if j else []
                if options:
                    how[i, j], score[i, j] = max(options, key=lambda x: x[1])
        i, j, steps = n, m, []
        while i or j:
            step = str(how[i, j])
            i, j = i - (step in "MD"), j - (step in "MI")
            steps.append((step, i if step != "I" else None, j if step != "D" else None))
        return float(score[n, m] + _log(1 - self.p_ins)), steps[::-1]


def simulated(master: Tokens, model: Indel, rng: np.random.Generator) -> list:
    """One observation."""
    out = []
    for m in [*master, None]:
        while rng.random() < model.p_ins:
            out.append(model.background.draw(rng))
        if m is not None and rng.random() >= model.p_del:
            out.append(model.background.draw(rng) if rng.random() < model.eps else m)
    return out


def simulated_set(master: Tokens, model: Indel, n: int, seed: int = 0) -> list[list]:
    return [simulated(master, model, np.random.default_rng([seed, i])) for i in range(n)]
