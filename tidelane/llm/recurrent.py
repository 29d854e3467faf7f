"""A gated recurrent network over symbols in NumPy: class-factored softmax, truncated backpropagation, carried state.

A symbol is one of the frequent words, which stand in classes of WORDS each, or a class of other words. The network gives
each symbol's probability from all symbols of its document before it: first the class, then, for a frequent word, the word
within its class. What an other word is within its class is not the network's matter.

Documents lie in lanes, one after the other. Each step takes one symbol of every lane; a lane's state passes from window to
window and starts anew where a document starts, so a document is scored whole whatever its length.
"""

from __future__ import annotations

import heapq

import numpy as np

WORDS = 16  # frequent words in a class
HIDDEN = 16
WINDOW = 16  # steps that a gradient goes back
TOKENS_A_LANE = 2048
MOST_LANES = 512
RATE = 0.05
F32 = np.float32


class Network:
    """Parameters in one flat vector, with a view for each part."""

    def __init__(self, frequent: int, other: int, flat: np.ndarray | None = None):
        """frequent: words with a symbol of their own, a multiple of WORDS; other: classes of other words."""
        self.frequent, self.near = frequent, frequent // WORDS
        self.classes = self.near + other
        h, n = HIDDEN, frequent + other
        # c and w: the last row is the bias, for states stand beside a 1
        shapes = {"x": (n, 3 * h), "u": (h, 3 * h), "c": (h + 1, self.classes), "w": (self.near, h + 1, WORDS)}
        self.flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), F32) if flat is None else flat
        self.part, at = {}, 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            self.part[name] = self.flat[at : at + size].reshape(shape)
            at += size

    @classmethod
    def fresh(cls, counts: np.ndarray, other: int) -> Network:
        """Probabilities are those of the counts of the symbols until something is learned. The same at every call."""
        net = cls(len(counts) - other, other)
        random = np.random.default_rng(13)
        p = net.part
        p["x"][:] = random.normal(0, 0.3, p["x"].shape)
        p["u"][:] = random.normal(0, 0.5 / np.sqrt(HIDDEN), p["u"].shape)
        p["x"][:, :HIDDEN] += 1.0  # keep more than forget
        seen = counts.astype(float) + 0.5
        words = seen[: net.frequent].reshape(net.near, WORDS)
        p["c"][HIDDEN] = np.log(np.concatenate([words.sum(1), seen[net.frequent :]]) / seen.sum())
        p["w"][:, HIDDEN] = np.log(words / words.sum(1, keepdims=True))
        return net

    def window(self, symbols: np.ndarray, starts: np.ndarray, state: np.ndarray, grad: Network | None = None, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probabilities [steps, lanes] of the symbols (-1: none, 0.0) and the state after them.

        grad: gets the gradient of the sum of their losses, times share, added.
        """
        p, h = self.part, HIDDEN
        steps, lanes = symbols.shape
        seen, gates, after = np.ones((steps, lanes, h + 1), F32), np.empty((steps, lanes, 3 * h), F32), np.empty((steps, lanes, h), F32)
        inputs = np.take(p["x"], np.maximum(symbols, 0), axis=0)
        keep = (~starts).astype(F32)[:, :, None]
        for t in range(steps):
            before = np.multiply(state, keep[t], out=seen[t, :, :h])
            a, g = before @ p["u"], gates[t]
            zr = g[:, : 2 * h]
            np.add(inputs[t, :, : 2 * h], a[:, : 2 * h], out=zr)
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            after[t] = a[:, 2 * h :]
            n = g[:, 2 * h :]
            np.multiply(g[:, h : 2 * h], after[t], out=n)
            n += inputs[t, :, 2 * h :]
            np.tanh(n, out=n)
            state = before - n
            state *= g[:, :h]
            state += n
        logp, d_seen = self._output(seen.reshape(-1, h + 1), symbols.reshape(-1), grad, share)
        if grad is not None:
            self._back(symbols, keep, seen, gates, after, d_seen[:, :h].reshape(steps, lanes, h), grad)
        return logp.reshape(steps, lanes), state

    def _output(self, seen: np.ndarray, symbols: np.ndarray, grad: Network | None, share: float) -> tuple[np.ndarray, np.ndarray | None]:
        real = np.flatnonzero(symbols >= 0)
        if len(real) < len(symbols):
            logp, d = np.zeros(len(symbols), F32), None if grad is None else np.zeros_like(seen)
            if len(real):
                logp[real], d_some = self._output(seen[real], symbols[real], grad, share)
                if d is not None:
                    d[real] = d_some
            return logp, d
        p = self.part
        kind = np.where(symbols < self.frequent, symbols // WORDS, symbols - (self.frequent - self.near)).astype(np.uint8 if self.classes <= 256 else np.uint16)
        logp, e = self._softmax(seen @ p["c"], kind, share, grad)
        d = None
        if grad is not None:
            grad.part["c"] += seen.T @ e
            d = e @ p["c"].T
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(self.near + 1)).tolist()
        order = order[: cuts[-1]]
        s, e = seen[order], np.empty((len(order), WORDS), F32)
        runs = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        for k, own in runs:
            np.matmul(s[own], p["w"][k], out=e[own])
        within, e = self._softmax(e, symbols[order] % WORDS, share, grad)
        logp[order] += within
        if grad is not None:
            back = np.empty_like(s)
            for k, own in runs:
                grad.part["w"][k] += s[own].T @ e[own]
                np.matmul(e[own], p["w"][k].T, out=back[own])
            d[order] += back
        return logp, d

    @staticmethod
    def _softmax(e: np.ndarray, right: np.ndarray, share: float, grad) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of the right columns and, in place of e, the loss' gradient by e where that is asked for.

        Logits stay small, for states lie within 1 and weights are bounded by the rate: no maximum is taken off.
        """
        rows = np.arange(len(e))
        logp = e[rows, right]
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], F32)
        logp -= np.log(total)
        if grad is not None:
            e *= (share / total)[:, None]
            e[rows, right] -= F32(share)
        return logp, e

    def _back(self, symbols, keep, seen, gates, after, d_seen, grad: Network) -> None:
        p, h = self.part, HIDDEN
        steps, lanes = symbols.shape
        seen = seen[:, :, :h]
        d_in, d_a = np.empty((steps, lanes, 3 * h), F32), np.empty((steps, lanes, 3 * h), F32)
        d_state = np.zeros((lanes, h), F32)
        for t in range(steps - 1, -1, -1):
            z, r, n = gates[t, :, :h], gates[t, :, h : 2 * h], gates[t, :, 2 * h :]
            d_n = d_state * (1 - z) * (1 - n * n)
            d_in[t, :, 2 * h :] = d_n
            d_in[t, :, :h] = d_state * (seen[t] - n) * z * (1 - z)
            d_in[t, :, h : 2 * h] = d_n * after[t] * r * (1 - r)
            d_a[t, :, : 2 * h] = d_in[t, :, : 2 * h]
            d_a[t, :, 2 * h :] = d_n * r
            d_state = d_state * z + d_a[t] @ p["u"].T + d_seen[t]
            d_state *= keep[t]
        grad.part["u"] += np.ascontiguousarray(seen).reshape(-1, h).T @ d_a.reshape(-1, 3 * h)
        at, d = symbols.reshape(-1).astype(np.int16), d_in.reshape(-1, 3 * h)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-2))
        rows = at[order[first]]
        sums = np.add.reduceat(d[order], first, axis=0)
        grad.part["x"][rows[rows >= 0]] += sums[rows >= 0]


class Lanes:
    """Documents dealt to lanes, longest first and each to the shortest lane; the longest lane stands first."""

    def __init__(self, documents: list[np.ndarray]):
        sizes = np.array([len(d) for d in documents], np.int64)
        width = int(np.clip(sizes.sum() // TOKENS_A_LANE, 16, MOST_LANES))
        width = max(1, min(width, len(documents)))
        heap, dealt = [(0, k) for k in range(width)], [[] for _ in range(width)]
        for d in np.argsort(-sizes, kind="stable").tolist():
            n, k = heapq.heappop(heap)
            dealt[k].append(d)
            heapq.heappush(heap, (n + int(sizes[d]), k))
        dealt.sort(key=lambda own: -sum(int(sizes[d]) for d in own))
        order = [d for own in dealt for d in own]
        self.length = np.array([sum(int(sizes[d]) for d in own) for own in dealt], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.symbols = np.concatenate([*(documents[d] for d in order), np.zeros(0, np.int16)])
        self.owner = np.repeat(np.array(order, np.int32), sizes[order])
        self.start = np.zeros(len(self.symbols) + 1, bool)
        self.start[(np.cumsum(sizes[order]) - sizes[order])] = True

    def windows(self):
        """(lanes still going, symbols, starts, owners) of each window, by step and lane; symbol -1 after a lane's end."""
        for t in range(0, int(self.length.max(initial=0)), WINDOW):
            live = int((self.length > t).sum())
            at = np.arange(t, t + WINDOW)[:, None]
            there = at < self.length[:live]
            at = np.where(there, self.first[:live] + at, 0)
            yield live, np.where(there, self.symbols[at], -1), self.start[at] & there, self.owner[at]


def score(net: Network, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document's symbols."""
    out, dealt = np.zeros(len(documents)), Lanes(documents)
    state = np.zeros((len(dealt.length), HIDDEN), F32)
    for live, symbols, starts, owners in dealt.windows():
        logp, state = net.window(symbols, starts, state[:live])
        out += np.bincount(owners.reshape(-1), logp.reshape(-1), len(documents))
    return out


def train(net: Network, squares: np.ndarray, documents: list[np.ndarray]) -> int:
    """One pass over the documents in place; squares: running squares of gradients by parameter. Returns the symbols read."""
    dealt, grad = Lanes(documents), Network(net.frequent, net.classes - net.near)
    state = np.zeros((len(dealt.length), HIDDEN), F32)
    for live, symbols, starts, _ in dealt.windows():
        grad.flat[:] = 0
        # a window of few lanes, where long documents end, weighs as little as it has symbols
        _, state = net.window(symbols, starts, state[:live], grad, 1 / (WINDOW * len(dealt.length)))
        g = grad.flat
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g /= norm
        squares += g * g
        net.flat -= RATE * g / (np.sqrt(squares) + 1e-6)
    return len(dealt.symbols)
