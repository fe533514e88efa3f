"""Linear-chain conditional random field in numpy: training by gradient ascent, decoding by Viterbi, both in batches."""

from __future__ import annotations

import zlib

import numpy as np

BUCKETS = 1 << 12


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


class CRF:
    """``emission`` has a row for each hashed feature, ``move`` scores label pairs, ``start`` first labels."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.emission = np.zeros((BUCKETS, k))
        self.move = np.zeros((k, k))
        self.start = np.zeros(k)

    def scores(self, rows: list[list[list[int]]], width: int) -> np.ndarray:
        """Emission scores, padded to (sequence, width, label)."""
        out = np.zeros((len(rows), width, len(self.labels)))
        flat = [f for row in rows for token in row for f in token]
        if flat:
            counts = np.array([len(t) for row in rows for t in row])
            sums = np.add.reduceat(self.emission[np.array(flat)], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
            which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            place = np.concatenate([np.arange(len(r)) for r in rows])
            out[which, place] = sums
        return out

    def decode(self, rows: list[list[list[int]]]) -> list[list[str]]:
        """Best label sequences; each token is the list of its feature buckets (at least one)."""
        out: list[list[str]] = [[]] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        for at in range(0, len(order), 256):
            part = [i for i in order[at : at + 256] if rows[i]]
            if not part:
                continue
            batch = [rows[i] for i in part]
            width = max(map(len, batch))
            for i, path in zip(part, self._viterbi(self.scores(batch, width), np.array([len(b) for b in batch])), strict=True):
                out[i] = [self.labels[j] for j in path]
        return out

    def _viterbi(self, emit: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        many, width, k = emit.shape
        best = emit[:, 0] + self.start
        back = np.zeros((width, many, k), np.int32)
        for t in range(1, width):
            total = best[:, :, None] + self.move
            step = total.argmax(axis=1)
            new = np.take_along_axis(total, step[:, None, :], axis=1)[:, 0] + emit[:, t]
            inside = (t < lengths)[:, None]
            back[t] = np.where(inside, step, np.arange(k))
            best = np.where(inside, new, best)
        last = best.argmax(axis=1)
        paths = np.zeros((many, width), np.int64)
        for t in range(width - 1, -1, -1):
            paths[:, t] = last
            last = back[t][np.arange(many), last]
        return [paths[i, :n].tolist() for i, n in enumerate(lengths)]

    def fit(self, rows: list[list[list[int]]], tags: list[list[int]], rounds: int = 60, rate: float = 0.5, l2: float = 1e-3) -> CRF:
        """AdaGrad on the conditional log-likelihood of all sequences at once; deterministic."""
        keep = [i for i, r in enumerate(rows) if r]
        rows, tags = [rows[i] for i in keep], [tags[i] for i in keep]
        if not rows:
            return self
        many, k = len(rows), len(self.labels)
        lengths = np.array([len(r) for r in rows])
        width = int(lengths.max())
        gold = np.zeros((many, width), np.int64)
        for i, t in enumerate(tags):
            gold[i, : len(t)] = t
        mask = np.arange(width) < lengths[:, None]
        flat = np.array([f for row in rows for token in row for f in token])
        counts = np.array([len(t) for row in rows for t in row])
        token = np.repeat(np.arange(len(counts)), counts)
        seen = [np.full_like(x, 1e-8) for x in (self.emission, self.move, self.start)]
        eye = np.eye(k)
        pairs = mask[:, 1:]
        for _ in range(rounds):
            emit = self.scores(rows, width)
            ahead = np.zeros((many, width, k))
            ahead[:, 0] = self.start + emit[:, 0]
            for t in range(1, width):
                new = _logsum(ahead[:, t - 1][:, :, None] + self.move, 1) + emit[:, t]
                ahead[:, t] = np.where(mask[:, t][:, None], new, ahead[:, t - 1])
            total = _logsum(ahead[:, -1], 1)
            behind = np.zeros((many, width, k))
            for t in range(width - 2, -1, -1):
                new = _logsum(self.move + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
                behind[:, t] = np.where(mask[:, t + 1][:, None], new, 0)
            marginal = np.exp(ahead + behind - total[:, None, None])
            diff = (eye[gold] - marginal) * mask[:, :, None]
            both = np.exp(ahead[:, :-1, :, None] + self.move + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
            move = np.zeros((k, k))
            np.add.at(move, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
            grads = [np.zeros_like(self.emission), move - both.sum((0, 1)), diff[:, 0].sum(0)]
            np.add.at(grads[0], flat, diff[mask][token])
            for value, grad, sq in zip((self.emission, self.move, self.start), grads, seen, strict=True):
                grad = grad - l2 * many * value
                sq += grad * grad
                value += rate * grad / np.sqrt(sq)
        return self


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)
