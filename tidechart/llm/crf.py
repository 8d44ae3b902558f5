"""A linear-chain conditional random field with two labels and sets of binary features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """weight: by feature, for label 1 over label 0; move[a, b]: from label a to b; start and stop by label."""

    index: dict[str, int]
    weight: np.ndarray
    move: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    def decode(self, items: list[list[str]], barred: list[bool] | None = None) -> list[int]:
        """The most probable labels of a sequence (Viterbi), of those that give barred items label 0."""
        if not items:
            return []
        find, weight = self.index.get, self.weight
        score = [0.0, 0.0]
        back: list[tuple[int, int]] = []
        move = self.move.tolist()
        for k, names in enumerate(items):
            own = -1e9 if barred and barred[k] else float(sum(weight[i] for i in map(find, names) if i is not None))
            if k == 0:
                score = [float(self.start[0]), float(self.start[1]) + own]
                continue
            from0 = (score[0] + move[0][0], score[1] + move[1][0])
            from1 = (score[0] + move[0][1], score[1] + move[1][1])
            back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
            score = [max(from0), max(from1) + own]
        last = int(score[1] + self.stop[1] > score[0] + self.stop[0])
        out = [last]
        for step in reversed(back):
            last = step[last]
            out.append(last)
        return out[::-1]


class _Data:
    """Sequences as padded arrays, and what is seen in them."""

    def __init__(self, sequences: list[tuple[list[list[str]], list[int]]], index: dict[str, int]):
        n, longest = len(sequences), max((len(s[0]) for s in sequences), default=1)
        self.x = np.zeros((n, longest, len(index)), np.float32)
        self.mask = np.zeros((n, longest), bool)
        y = np.zeros((n, longest), int)
        for r, (items, labels) in enumerate(sequences):
            self.mask[r, : len(items)] = True
            y[r, : len(items)] = labels
            for t, item in enumerate(items):
                self.x[r, t, [index[f] for f in item]] = 1
        self.rows, self.ends, self.both = np.arange(n), self.mask.sum(1) - 1, self.mask[:, 1:]
        move = np.zeros((2, 2))
        np.add.at(move, (y[:, :-1][self.both], y[:, 1:][self.both]), 1)
        of = np.einsum("rtf,rt->f", self.x, (y * self.mask).astype(np.float32))
        self.seen = [of, move, np.bincount(y[:, 0], minlength=2), np.bincount(y[self.rows, self.ends], minlength=2)]

    def gradient(self, parts: list[np.ndarray], ridge: float) -> list[np.ndarray]:
        """Of the mean negative log-likelihood with a ridge, by forward-backward over all sequences at once."""
        weight, move, start, stop = parts
        n, longest, _ = self.x.shape
        mask, rows, ends, both = self.mask, self.rows, self.ends, self.both
        own = np.zeros((n, longest, 2))
        own[..., 1] = self.x @ weight.astype(np.float32)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = start + own[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + move, axis=1) + own[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        behind = np.zeros((n, longest, 2))
        behind[:, longest - 1] = stop
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(move + (own[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], step, stop)
        total = np.logaddexp.reduce(ahead[rows, ends] + stop, axis=1)
        prob = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
        onward = (own[:, 1:] + behind[:, 1:])[:, :, None, :]
        pair = np.exp(ahead[:, :-1, :, None] + move + onward - total[:, None, None, None]) * both[..., None, None]
        of = np.einsum("rtf,rt->f", self.x, prob[..., 1].astype(np.float32))
        expected = [of, pair.sum((0, 1)), prob[:, 0].sum(0), prob[rows, ends].sum(0)]
        return [(a - b) / n + ridge * p for p, a, b in zip(parts, expected, self.seen, strict=True)]


def gradient(sequences: list[tuple[list[list[str]], list[int]]], index: dict[str, int], parts: list[np.ndarray], ridge: float) -> list[np.ndarray]:
    return _Data(sequences, index).gradient(parts, ridge)


def fit_crf(sequences: list[tuple[list[list[str]], list[int]]], rounds: int = 160, rate: float = 0.1, ridge: float = 2e-3) -> Crf:
    """Maximum likelihood with a ridge, by Adam."""
    sequences = [s for s in sequences if s[0]]
    names = sorted({f for items, _ in sequences for item in items for f in item})
    index = {f: i for i, f in enumerate(names)}
    data = _Data(sequences, index)
    parts = [np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    first = [np.zeros_like(p) for p in parts]
    second = [np.zeros_like(p) for p in parts]
    for k in range(1, rounds + 1):
        for p, g, f, s in zip(parts, data.gradient(parts, ridge), first, second, strict=True):
            f *= 0.9
            f += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            p -= rate * (f / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return Crf(index, *parts)
