"""A character-level bidirectional LSTM with a linear-chain CRF, in numpy: training and windowed decoding."""

from __future__ import annotations

import numpy as np

PAD, WIDE_LETTER, WIDE_OTHER, BLANK = 0, 97, 98, 99
SYMBOLS = 100
#: Places of a long run that are decoded together.
BLOCK = 64
_TABLE = np.zeros(128, np.int64)
_TABLE[32:127] = np.arange(1, 96)
_TABLE[[9, 10, 11, 12, 13]] = BLANK
_TABLE[[*range(0, 9), *range(14, 32), 127]] = WIDE_OTHER


def encode(text: str) -> np.ndarray:
    """A symbol for each code point."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], np.where(points < 0x2000, WIDE_LETTER, WIDE_OTHER))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Parameters: for both directions input, recurrent and bias weights; emission weights; transitions."""

    def __init__(self, tags: int, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        self.p = {
            "x": r.normal(0, 0.3, (2, SYMBOLS, 4 * hidden)).astype(np.float32),
            "u": r.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)).astype(np.float32),
            "w": r.normal(0, (2 * hidden) ** -0.5, (2 * hidden, tags)).astype(np.float32),
            "b": np.zeros(tags, np.float32),
            "t": np.zeros((tags, tags), np.float32),
        }
        self.p["x"][:, :, hidden : 2 * hidden] += 1.0  # forget gates start open
        self.p["b"][0] = 1.0

    def _lstm(self, x: np.ndarray, keep: bool):
        """x: (batch, length) symbols. Hidden states of both directions, (2, batch, length, hidden), by place."""
        h, (n, length) = self.hidden, x.shape
        both = np.stack([x, x[:, ::-1]])
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out, kept = np.empty((2, length, n, h), np.float32), []
        rows = np.arange(2)[:, None]
        for t in range(length):
            z = self.p["x"][rows, both[:, :, t]] + state @ self.p["u"]
            gates = _sigmoid(z[..., : 3 * h])
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            g = np.tanh(z[..., 3 * h :])
            before, cell = cell, f * cell + i * g
            tanh = np.tanh(cell)
            if keep:
                kept.append((state, before, i, f, o, g, tanh))
            state = o * tanh
            out[:, t] = state
        return out, both, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(batch, length, tags)."""
        out, _, _ = self._lstm(x, False)
        joined = np.concatenate([out[0], out[1, ::-1]], -1)
        return (joined @ self.p["w"] + self.p["b"]).transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y, and its gradients."""
        n, length = x.shape
        out, both, kept = self._lstm(x, True)
        joined = np.concatenate([out[0], out[1, ::-1]], -1)  # (length, batch, 2 hidden)
        e, tr = joined @ self.p["w"] + self.p["b"], self.p["t"]
        soft = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, length):
            alpha[t] = e[t] + soft(alpha[t - 1][:, :, None] + tr, 1)
        for t in range(length - 2, -1, -1):
            beta[t] = soft(tr + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = soft(alpha[-1], 1)
        yt, rows = y.T, np.arange(n)
        gold = sum(e[t, rows, yt[t]] for t in range(length)) + sum(tr[yt[t - 1], yt[t]] for t in range(1, length))
        de = np.exp(alpha + beta - log_z[None, :, None])
        dt = np.zeros_like(tr)
        for t in range(1, length):
            dt += np.exp(alpha[t - 1][:, :, None] + tr + (e[t] + beta[t])[:, None, :] - log_z[:, None, None]).sum(0)
            np.add.at(dt, (yt[t - 1], yt[t]), -1.0)
        for t in range(length):
            de[t, rows, yt[t]] -= 1.0
        de, dt = de / n, dt / n
        grads = {"w": np.einsum("tnh,tnk->hk", joined, de), "b": de.sum((0, 1)), "t": dt}
        back = de @ self.p["w"].T
        h = self.hidden
        dh_all = np.stack([back[..., :h], back[::-1, :, h:]])
        dx, du = np.zeros_like(self.p["x"]), np.zeros_like(self.p["u"])
        dh_next, dc_next = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        ut = self.p["u"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            state, before, i, f, o, g, tanh = kept[t]
            dh = dh_all[:, t] + dh_next
            dc = dc_next + dh * o * (1 - tanh * tanh)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g * g)], -1)
            du += state.transpose(0, 2, 1) @ dz
            for d in range(2):
                np.add.at(dx[d], both[d, :, t], dz[d])
            dh_next, dc_next = dz @ ut, dc * f
        grads |= {"x": dx, "u": du}
        return float((log_z - gold).mean()), grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 96, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over seeded batches; the losses."""
        r, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        for step in range(1, steps + 1):
            at = r.integers(0, len(x), batch)
            loss, grads = self.gradients(x[at], y[at])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return losses

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tag paths for emissions (batch, length, tags)."""
        n, length, k = e.shape
        score, back = e[:, 0], np.empty((length, n, k), np.int8)
        for t in range(1, length):
            all_ = score[:, :, None] + self.p["t"]
            back[t] = all_.argmax(1)
            score = all_.max(1) + e[:, t]
        path = np.empty((n, length), np.int8)
        path[:, -1] = score.argmax(1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = np.take_along_axis(back[t], path[:, t, None].astype(np.intp), 1)[:, 0]
        return path

    def decode_runs(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best tag paths of emissions (length, tags) of different lengths."""
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(runs)
        short: dict[int, list[int]] = {}
        for i, e in enumerate(runs):
            if len(e) > 4 * BLOCK:
                out[i] = self.decode_long(e)
            else:
                short.setdefault(len(e), []).append(i)
        for at in short.values():
            for first in range(0, len(at), 1024):
                part = at[first : first + 1024]
                for i, path in zip(part, self.decode(np.stack([runs[i] for i in part])), strict=True):
                    out[i] = path
        return out

    def decode_long(self, e: np.ndarray) -> np.ndarray:
        """The best path of one long run: blocks are solved together for every tag before them, then joined."""
        tr, k = self.p["t"], e.shape[1]
        n = -(-(len(e) - 1) // BLOCK)
        steps = np.zeros((n * BLOCK, k), e.dtype)
        steps[: len(e) - 1] = e[1:]
        steps = steps.reshape(n, BLOCK, k)
        idle = BLOCK * n - (len(e) - 1)  # places past the end, in the last block
        most = np.full((n, k, k), -1e30, np.float32)  # by block, tag before it and its last tag
        most[:, np.arange(k), np.arange(k)] = 0
        for first in range(0, n, 2048):
            own = most[first : first + 2048]
            for t in range(BLOCK):
                live = len(own) - (first + len(own) == n and t >= BLOCK - idle)
                own[:live] = (own[:live, :, :, None] + tr).max(2) + steps[first : first + live, t, None, :]
        score, came = e[0].astype(np.float64), np.empty((n, k), np.intp)
        for i in range(n):
            both = score[:, None] + most[i]
            came[i], score = both.argmax(0), both.max(0)
        tags = np.empty(n + 1, np.intp)  # at block ends
        tags[n] = score.argmax()
        for i in range(n - 1, -1, -1):
            tags[i] = came[i, tags[i + 1]]
        now, back = np.where(np.arange(k) == tags[:-1, None], 0, -1e30).astype(np.float32), np.empty((BLOCK, n, k), np.int8)
        for t in range(BLOCK):
            live = n - (t >= BLOCK - idle)
            both = now[:live, :, None] + tr
            back[t, :live], back[t, live:] = both.argmax(1), np.arange(k)
            now[:live] = both.max(1) + steps[:live, t]
        path = np.empty((n, BLOCK + 1), np.int8)
        path[:, BLOCK] = tags[1:]
        for t in range(BLOCK - 1, -1, -1):
            path[:, t] = np.take_along_axis(back[t], path[:, t + 1, None].astype(np.intp), 1)[:, 0]
        return np.concatenate([tags[:1].astype(np.int8), path[:, 1:].reshape(-1)])[: len(e)]
