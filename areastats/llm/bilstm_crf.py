"""A small character tagger in numpy: embedding, bidirectional LSTM, linear layer, CRF.

``train`` fits it by back-propagation through time on the negative log-likelihood of the CRF
(forward-backward in the log domain, Adam). The seed and the order of the examples fix it.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

#: Characters: ASCII by code, other letters, other digits, anything else; 0 also pads.
CHARS = 131


def char_ids(codes: np.ndarray) -> np.ndarray:
    """Ids of code points (uint32)."""
    out = np.minimum(codes, 130).astype(np.int64)
    high = np.flatnonzero(codes > 127)
    if len(high):
        kinds = {int(c): 128 if chr(c).isalpha() else 129 if chr(c).isdigit() else 130 for c in np.unique(codes[high])
                 if c < 0xD800 or 0xDFFF < c <= 0x10FFFF}
        out[high] = [kinds.get(int(c), 130) for c in codes[high]]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Tagger:
    p: dict[str, np.ndarray]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tagger:
        with np.load(io.BytesIO(raw)) as f:
            return cls({n: f[n] for n in f.files})

    @property
    def tags(self) -> int:
        return self.p["out_b"].shape[0]

    def _lstm(self, x: np.ndarray, mask: np.ndarray, way: str):
        """Hidden states (time, batch, hidden) and what the backward pass needs."""
        wx, wh, b = (self.p[f"{way}_{n}"] for n in ("wx", "wh", "b"))
        steps, batch, size = x.shape[0], x.shape[1], wh.shape[0]
        pre = x @ wx + b
        h, c = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
        hs = np.zeros((steps, batch, size), np.float32)
        saved = [None] * steps
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ wh
            ifo = _sigmoid(z[:, :3 * size])
            g = np.tanh(z[:, 3 * size:])
            i, f, o = ifo[:, :size], ifo[:, size:2 * size], ifo[:, 2 * size:]
            old_h, old_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            on = mask[t][:, None]
            h, c = o * tc * on, c * on
            hs[t] = h
            saved[t] = (i, f, o, g, tc, old_h, old_c)
        return hs, saved

    def _lstm_back(self, x, mask, way, saved, dhs, grads):
        wx, wh = self.p[f"{way}_wx"], self.p[f"{way}_wh"]
        steps, batch, size = dhs.shape
        dh, dc = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
        dz = np.zeros((steps, batch, 4 * size), np.float32)
        for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
            i, f, o, g, tc, old_h, old_c = saved[t]
            on = mask[t][:, None]
            dh = (dh + dhs[t]) * on
            dc = dc * on + dh * o * (1 - tc * tc)
            d = dz[t]
            d[:, :size] = dc * g * i * (1 - i)
            d[:, size:2 * size] = dc * old_c * f * (1 - f)
            d[:, 2 * size:3 * size] = dh * tc * o * (1 - o)
            d[:, 3 * size:] = dc * i * (1 - g * g)
            grads[f"{way}_wh"] += old_h.T @ d
            dh, dc = d @ wh.T, dc * f
        flat = dz.reshape(-1, 4 * size)
        grads[f"{way}_wx"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[f"{way}_b"] += flat.sum(axis=0)
        return dz @ wx.T

    def emissions(self, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Tag scores (time, batch, tags) of windows (batch, time)."""
        x, on = self.p["emb"][ids.T], mask.T.astype(np.float32)
        hf, sf = self._lstm(x, on, "f")
        hb, sb = self._lstm(x, on, "b")
        h = np.concatenate((hf, hb), axis=2)
        e = h @ self.p["out_w"] + self.p["out_b"]
        return (e, (x, on, h, sf, sb)) if keep else e

    def _alpha_beta(self, e: np.ndarray, mask: np.ndarray):
        """Forward and backward log scores; positions behind a window's end carry on unchanged."""
        steps, batch, k = e.shape
        trans = self.p["trans"].astype(np.float64)
        e = e.astype(np.float64)
        alpha, beta = np.zeros((steps, batch, k)), np.zeros((steps, batch, k))
        alpha[0] = self.p["start"] + e[0]
        for t in range(1, steps):
            new = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + e[t]
            alpha[t] = np.where(mask[:, t, None], new, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            new = _logsumexp(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[:, t + 1, None], new, beta[t + 1])
        return alpha, beta, _logsumexp(alpha[-1], 1)

    def marginals(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Posterior probabilities (batch, time, tags)."""
        alpha, beta, z = self._alpha_beta(self.emissions(ids, mask), mask)
        return np.exp(alpha + beta - z[:, None]).transpose(1, 0, 2)

    def loss(self, ids: np.ndarray, mask: np.ndarray, tags: np.ndarray, grads: dict) -> float:
        """Mean negative log-likelihood of a batch; adds its gradient to ``grads``."""
        e, (x, on, h, sf, sb) = self.emissions(ids, mask, keep=True)
        alpha, beta, z = self._alpha_beta(e, mask)
        steps, batch, k = e.shape
        trans = self.p["trans"].astype(np.float64)
        rows = np.arange(batch)
        de = np.exp(alpha + beta - z[:, None]) * mask.T[:, :, None]
        gold = self.p["start"][tags[:, 0]] + e[0, rows, tags[:, 0]]
        grads["start"] += de[0].sum(axis=0) - np.bincount(tags[:, 0], minlength=k)
        on_time, now, before = mask.T, tags.T[1:], tags.T[:-1]
        pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None])
        grads["trans"] += pair[on_time[1:]].sum(axis=0)
        np.add.at(grads["trans"], (before[on_time[1:]], now[on_time[1:]]), -1.0)
        score = trans[before, now] + np.take_along_axis(e[1:], now[:, :, None], 2)[:, :, 0]
        gold = gold + (score * on_time[1:]).sum(axis=0)
        np.put_along_axis(de, tags.T[:, :, None],
                          np.take_along_axis(de, tags.T[:, :, None], 2) - on_time[:, :, None], 2)
        de = (de / batch).astype(np.float32)
        grads["start"] /= batch
        grads["trans"] /= batch
        grads["out_w"] += h.reshape(-1, h.shape[2]).T @ de.reshape(-1, k)
        grads["out_b"] += de.sum(axis=(0, 1))
        dh = de @ self.p["out_w"].T
        half = h.shape[2] // 2
        dx = self._lstm_back(x, on, "f", sf, dh[:, :, :half], grads)
        dx += self._lstm_back(x, on, "b", sb, dh[:, :, half:], grads)
        np.add.at(grads["emb"], ids.T.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((z - gold).mean())

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The best tag sequence for log scores (time, tags) with this model's legal transitions."""
        illegal = np.where(self.p["legal"], 0.0, -1e9)
        first = np.where(self.p["legal_start"], 0.0, -1e9)
        back = np.zeros(scores.shape, np.int64)
        best = first + scores[0]
        for t in range(1, len(scores)):
            step = best[:, None] + illegal
            back[t] = step.argmax(axis=0)
            best = step.max(axis=0) + scores[t]
        path = np.zeros(len(scores), np.int64)
        path[-1] = best.argmax()
        for t in range(len(scores) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def new_tagger(legal: np.ndarray, legal_start: np.ndarray, emb: int = 12, hidden: int = 20, seed: int = 7) -> Tagger:
    """``legal[a, b]``: whether tag b may follow tag a; others are held at a very low score."""
    rng, k = np.random.default_rng(seed), len(legal)
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"emb": 0.5 * rng.standard_normal((CHARS, emb)).astype(np.float32), "out_w": normal(2 * hidden, k),
         "out_b": np.zeros(k, np.float32), "trans": np.where(legal, 0, -1e4).astype(np.float32),
         "start": np.zeros(k, np.float32), "legal": legal, "legal_start": legal_start}
    for way in "fb":
        p[f"{way}_wx"], p[f"{way}_wh"] = normal(emb, 4 * hidden), normal(hidden, 4 * hidden)
        p[f"{way}_b"] = np.zeros(4 * hidden, np.float32)
        p[f"{way}_b"][hidden:2 * hidden] = 1.0
    return Tagger(p)


def train(tagger: Tagger, ids: np.ndarray, mask: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 32,
          rate: float = 0.02, seed: int = 7) -> list[float]:
    """Adam for ``steps`` batches, the rate falling to a tenth; returns the losses."""
    rng, losses = np.random.default_rng(seed), []
    names = [n for n in tagger.p if not n.startswith("legal")]
    first = {n: np.zeros(tagger.p[n].shape) for n in names}
    second = {n: np.zeros(tagger.p[n].shape) for n in names}
    order = rng.permutation(len(ids))
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate((order, rng.permutation(len(ids))))
        own, order = order[:batch], order[batch:]
        grads = {n: np.zeros(tagger.p[n].shape) for n in names}
        losses.append(tagger.loss(ids[own], mask[own], tags[own], grads))
        grads["trans"][~tagger.p["legal"]] = 0.0
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-12))
        lr = rate * (0.1 + 0.9 * (1 - step / steps))
        for n in names:
            g = grads[n] * scale
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.99 * second[n] + 0.01 * g * g
            change = first[n] / (1 - 0.9 ** step) / (np.sqrt(second[n] / (1 - 0.99 ** step)) + 1e-8)
            tagger.p[n] = (tagger.p[n] - lr * change).astype(np.float32)
    return losses
