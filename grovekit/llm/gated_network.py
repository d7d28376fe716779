"""A gated recurrent network with a class-factored output layer, in numpy.

Inputs are token numbers; each has its own row of gate inputs. Outputs are factored: first a softmax over classes, then
one over the members of the class. The frequent tokens, in order of frequency, fill ``listed`` classes of
``members`` each, and have a softmax of their own there, given the state. All other tokens belong to ``tails`` further classes by
their ending; their share of the class is fixed and not this network's business.
"""

from __future__ import annotations

import heapq

import numpy as np

F32 = np.float32
#: Rows whose outputs are computed at once; they stay in a core's cache.
BLOCK = 1024


class Shape:
    def __init__(self, hidden: int = 16, listed: int = 32, members: int = 32, tails: int = 64):
        self.hidden, self.listed, self.members, self.tails = hidden, listed, members, tails
        self.short = listed * members
        self.inputs, self.classes = self.short + tails, listed + tails


def start(shape: Shape, token_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights whose outputs are the counts' shares, whatever the state."""
    rng, h = np.random.default_rng(seed), shape.hidden
    counts = np.full(shape.short, 0.5)
    counts[: len(token_counts)] += token_counts
    grid = counts.reshape(shape.listed, shape.members)
    mass = np.concatenate([grid.sum(axis=1), tail_counts + 0.5])
    small = lambda *s: rng.normal(0, 0.15, s).astype(F32)
    return {
        "x": small(shape.inputs, 3 * h),
        "u": small(h, 2 * h),
        "n": small(h, h),
        "c": np.zeros((h, shape.classes), F32),
        "cb": np.log(mass / mass.sum()).astype(F32),
        "w": np.zeros((shape.listed, h, shape.members), F32),
        "wb": np.log(grid / grid.sum(axis=1, keepdims=True)).astype(F32),
    }


def _gates(p: dict) -> tuple[np.ndarray, np.ndarray, int]:
    """Inputs (token, 3h) and recurrent weights (3h, h); those of the two gates with the other sign, so that a gate is 1 / (1 + exp)."""
    h = p["n"].shape[0]
    x, un = p["x"].copy(), np.concatenate((p["u"], p["n"]), axis=1).T.copy()
    x[:, : 2 * h] *= F32(-1)
    un[: 2 * h] *= F32(-1)
    return x, un, h


def step(un: np.ndarray, x: np.ndarray, state: np.ndarray, out: np.ndarray | None = None):
    """The next state of (h, texts) by the weights and inputs (3h, texts) of ``_gates``, and what the way back needs: gates, the state's share and the new part."""
    h = len(state)
    z = un @ state
    gates = z[: 2 * h]
    gates += x[: 2 * h]
    np.exp(gates, out=gates)
    gates += F32(1)
    np.reciprocal(gates, out=gates)
    new = gates[h:] * z[2 * h :]
    new += x[2 * h :]
    np.tanh(new, out=new)
    after = np.subtract(state, new, out=out)
    after *= gates[:h]
    after += new
    return after, (gates, z[2 * h :], new)


def _with_bias(w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """The weights (.., h, outputs) with the bias as a last row, and whether exp of any output is finite: states lie between -1 and 1."""
    both = np.concatenate((w, bias[..., None, :]), axis=-2)
    return both, float(np.abs(both).sum(axis=-2).max(initial=0.0)) < 60


def _exp(logits: np.ndarray, safe: bool, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In place: exp of ``logits`` (rows, outputs), less each row's greatest unless ``safe``; with the sums of the rows, and the logits of the ``picked`` outputs on that scale."""
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(logits)), picked]
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], F32), own


def _classes(shape: Shape, targets: np.ndarray) -> np.ndarray:
    return np.where(targets < shape.short, targets // shape.members, targets - shape.short + shape.listed)


def _inside(shape: Shape, w: np.ndarray, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Rows of listed classes sorted by class, their states, their outputs inside the class, and each class's part of them."""
    order = np.argsort(classes.astype(np.int16), kind="stable")
    edges = np.searchsorted(classes[order], np.arange(shape.listed + 1)).tolist()
    order = order[: edges[-1]]
    own, parts = states[order], [(c, a, b) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    out = np.empty((len(order), shape.members), F32)
    for c, a, b in parts:
        np.matmul(own[a:b], w[c], out=out[a:b])
    return order, own, out, parts


def log_probabilities(p: dict, shape: Shape, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithms: of the class, plus for listed tokens of the member in the class."""
    outer, inner = (_with_bias(p[w], p[b])[0] for w, b in (("c", "cb"), ("w", "wb")))
    return _log_probabilities((outer, False), (inner, False), shape, np.column_stack((states, np.ones(len(states), F32))), targets)


def _log_probabilities(outer: tuple[np.ndarray, bool], inner: tuple[np.ndarray, bool], shape: Shape, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The same with the weights of ``_with_bias``; ``states`` (rows, h + 1) end in 1."""
    classes = _classes(shape, targets)
    _, total, out = _exp(states @ outer[0], outer[1], classes)
    out -= np.log(total)
    order, _, inside, _ = _inside(shape, inner[0], states, classes)
    _, total, own = _exp(inside, inner[1], targets[order] % shape.members)
    out[order] += own - np.log(total)
    return out


class Trainer:
    """Truncated backpropagation through time by AdaGrad; states are carried from window to window."""

    def __init__(self, p: dict[str, np.ndarray], shape: Shape, rate: float = 0.1, first: float = 1e-5):
        self.p = {k: v.copy() for k, v in p.items()}
        self.shape, self.rate = shape, rate
        self.seen = {k: np.full(v.shape, first, F32) for k, v in p.items()}

    def _move(self, name: str, gradient: np.ndarray, rows=None) -> None:
        at = slice(None) if rows is None else rows
        seen = self.seen[name][at] + gradient**2
        self.seen[name][at] = seen
        self.p[name][at] -= self.rate * gradient / np.sqrt(seen)

    def window(self, ids: np.ndarray, targets: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> np.ndarray:
        """ids, targets (-1: none) and fresh (a text starts: forget the state) are (time, streams), the state (h, streams). Returns the last state.

        States and gates are (h, streams), so that a gate is a block of rows; what is read out of all states at once is (tokens, outputs).
        """
        p, s, (h, streams), time = self.p, self.shape, state.shape, len(ids)
        order = np.argsort(ids.ravel().astype(np.int16 if s.inputs < 1 << 15 else np.int64), kind="stable")
        sorted_ids = ids.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
        un = np.concatenate((p["u"], p["n"]), axis=1).T.copy()
        un[: 2 * h] *= F32(-1)
        x = np.ascontiguousarray(p["x"].take(ids, axis=0).transpose(0, 2, 1))
        x[:, : 2 * h] *= F32(-1)
        live = (~fresh).astype(F32)
        before, gates, inner, new = (np.empty((time, k * h, streams), F32) for k in (1, 2, 1, 1))
        after = np.empty((time, h, streams), F32)
        for t in range(time):
            np.multiply(state, live[t], out=before[t])
            state, (gates[t], inner[t], new[t]) = step(un, x[t], before[t], after[t])
        there = targets.ravel() >= 0
        every = bool(there.all())
        goal = targets.ravel() if every else targets.ravel()[there]
        if not len(goal):
            return state
        states = np.ones((time * streams, h + 1), F32)
        states.reshape(time, streams, h + 1)[:, :, :h] = after.transpose(0, 2, 1)
        states = states if every else states[there]
        scale = F32(1 / len(goal))
        classes, rows = _classes(s, goal), np.arange(len(goal))
        outer, safe = _with_bias(p["c"], p["cb"])
        d_states, d_outer, back = np.empty((len(goal), h), F32), np.zeros_like(outer), np.ascontiguousarray(p["c"].T)
        for at in range(0, len(goal), BLOCK):
            own = states[at : at + BLOCK]
            wrong, total, _ = _exp(own @ outer, safe, classes[at : at + BLOCK])
            wrong *= (scale / total)[:, None]
            wrong[rows[: len(own)], classes[at : at + BLOCK]] -= scale
            np.matmul(wrong, back, out=d_states[at : at + BLOCK])
            d_outer += own.T @ wrong
        w, safe = _with_bias(p["w"], p["wb"])
        listed, own, inside, parts = _inside(s, w, states, classes)
        member = goal[listed] % s.members
        inside, total, _ = _exp(inside, safe, member)
        inside *= (scale / total)[:, None]
        inside[rows[: len(listed)], member] -= scale
        d_inner, d_own = np.zeros_like(w), np.empty((len(listed), h), F32)
        for c, a, b in parts:
            np.matmul(own[a:b].T, inside[a:b], out=d_inner[c])
            np.matmul(inside[a:b], p["w"][c].T, out=d_own[a:b])
        d_states[listed] += d_own
        full = d_states
        if not every:
            full = np.zeros((time * streams, h), F32)
            full[there] = d_states
        full = np.ascontiguousarray(full.reshape(time, streams, h).transpose(0, 2, 1))
        keep, reset = gates[:, :h], gates[:, h:]
        to_new, to_keep, to_reset = (1 - keep) * (1 - new**2), (before - new) * keep * (1 - keep), inner * reset * (1 - reset)
        d_z, d_new, d = np.empty((time, 3 * h, streams), F32), np.empty((time, h, streams), F32), np.zeros((h, streams), F32)
        back = np.concatenate((p["u"], p["n"]), axis=1)
        for t in range(time - 1, -1, -1):
            d += full[t]
            np.multiply(d, to_new[t], out=d_new[t])
            np.multiply(d, to_keep[t], out=d_z[t, :h])
            np.multiply(d_new[t], to_reset[t], out=d_z[t, h : 2 * h])
            np.multiply(d_new[t], reset[t], out=d_z[t, 2 * h :])
            d *= keep[t]
            d += back @ d_z[t]
            d *= live[t]
        d_un = np.matmul(before, d_z.transpose(0, 2, 1)).sum(axis=0)
        moves = {"c": d_outer[:h], "cb": d_outer[h], "w": d_inner[:, :h], "wb": d_inner[:, h], "u": d_un[:, : 2 * h], "n": d_un[:, 2 * h :]}
        for name, gradient in moves.items():
            self._move(name, np.clip(gradient, -1, 1))
        d_x = np.empty((time, streams, 3 * h), F32)
        d_x[:, :, : 2 * h], d_x[:, :, 2 * h :] = d_z[:, : 2 * h].transpose(0, 2, 1), d_new.transpose(0, 2, 1)
        self._move("x", np.add.reduceat(d_x.reshape(-1, 3 * h).take(order, axis=0), first, axis=0), sorted_ids[first])
        return state

    def run(self, texts: list[np.ndarray], streams: int = 256, window: int = 16, segment: int = 1024) -> int:
        """One pass over texts (token numbers, the end token last), laid one after another into streams. Returns the tokens read.

        Texts longer than ``segment`` are laid out in segments, each of which starts from its last input but without a state, so
        that a few very long texts don't leave all other streams empty. Scoring knows no segments.
        """
        parts = [(t[s : s + segment], t[s - 1] if s else 0) for t in texts for s in range(0, len(t), segment)]
        lanes: list[list[tuple[np.ndarray, int]]] = [[] for _ in range(min(streams, max(1, len(parts))))]
        heap = [(0, i) for i in range(len(lanes))]
        for part in sorted(parts, key=lambda x: len(x[0]), reverse=True):
            length, lane = heap[0]
            lanes[lane].append(part)
            heapq.heapreplace(heap, (length + len(part[0]), lane))
        lengths = [length for length, _ in heap]
        total = max(lengths, default=0)
        targets = np.full((total, len(lanes)), -1, np.int64)
        ids, fresh = np.zeros((total, len(lanes)), np.int64), np.zeros((total, len(lanes)), bool)
        for lane, own in enumerate(lanes):
            at = 0
            for t, before in own:
                targets[at : at + len(t), lane] = t
                ids[at, lane] = before
                ids[at + 1 : at + len(t), lane] = t[:-1]
                fresh[at, lane] = True
                at += len(t)
        state = np.zeros((self.shape.hidden, len(lanes)), F32)
        for at in range(0, total, window):
            state = self.window(ids[at : at + window], targets[at : at + window], fresh[at : at + window], state)
        return sum(lengths)


def text_scores(p: dict, shape: Shape, texts: list[np.ndarray], at_once: int = 4096) -> np.ndarray:
    """The natural log-likelihood of each text (token numbers, the end token last) without the fixed shares of tail tokens.

    All texts run side by side, the longest first, so those still running are the first ones; the state goes on from window to window.
    """
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    flat = np.concatenate([texts[i] for i in order]) if texts else np.empty(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1])) if texts else np.empty(0, np.int64)
    x, un, h = _gates(p)
    outer, inner = _with_bias(p["c"], p["cb"]), _with_bias(p["w"], p["wb"])
    longest = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(longest), side="left").tolist()
    totals, state, t = np.zeros(len(texts)), np.zeros((h, len(texts)), F32), 0
    before, seen, at = np.zeros(len(texts), np.int64), np.ones((at_once, h + 1), F32), 0
    goals, places = np.empty(at_once, np.int64), np.empty(at_once, np.int64)

    def score():
        nonlocal totals
        got = _log_probabilities(outer, inner, shape, seen[:at], goals[:at])
        totals += np.bincount(places[:at], weights=got, minlength=len(totals))

    for t in range(longest):
        n = running[t]
        if n < len(before):
            before, state = before[:n], np.ascontiguousarray(state[:, :n])
        state, _ = step(un, x.take(before, axis=0).T, state)
        before, low = flat[offsets[:n] + t], 0
        while low < n:  # a block is full at any place among the texts
            high = min(n, low + at_once - at)
            to = at + high - low
            seen[at:to, :h], goals[at:to], places[at:to] = state[:, low:high].T, before[low:high], np.arange(low, high)
            at, low = to, high
            if at == at_once:
                score()
                at = 0
    score()
    out[order] = totals
    return out
