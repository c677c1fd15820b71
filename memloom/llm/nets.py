"""Small recurrent networks in numpy. Arrays are (features, rows), so every gate is contiguous."""

from __future__ import annotations

import numpy as np


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _table_grad(size: int, codes: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """Sum of grad (features, n) by code, as (size, features)."""
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    starts = np.flatnonzero(np.r_[True, np.diff(sorted_codes) > 0])
    out = np.zeros((size, grad.shape[0]), grad.dtype)
    out[sorted_codes[starts]] = np.add.reduceat(grad[:, order], starts, axis=1).T
    return out


def half_sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Gru:
    """One direction of gated recurrent units over codes (steps, rows); mask is 0 at padding."""

    gates = 3

    @classmethod
    def init(cls, rng, codes: int, hidden: int, tag: str) -> dict[str, np.ndarray]:
        f = np.float32
        return {f"T{tag}": (rng.standard_normal((codes, 3 * hidden)) * 0.3).astype(f), f"U{tag}": (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(f)}

    def __init__(self, params: dict[str, np.ndarray], tag: str, reverse: bool):
        self.table, self.U, self.tag, self.reverse = params[f"T{tag}"], params[f"U{tag}"], tag, reverse

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        steps, rows = x.shape
        H = self.U.shape[1]
        table = np.ascontiguousarray(self.table.T)
        whole = mask.all(axis=1)
        out = np.empty((steps, H, rows), self.U.dtype)
        h = np.zeros((H, rows), self.U.dtype)
        a, u = np.empty((3 * H, rows), self.U.dtype), np.empty((3 * H, rows), self.U.dtype)
        tape = []
        for t in range(steps - 1, -1, -1) if self.reverse else range(steps):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.dot(self.U, h, out=u)
            g = half_sigmoid(a[: 2 * H] + u[: 2 * H] if keep else np.add(a[: 2 * H], u[: 2 * H], out=a[: 2 * H]))
            z, r = g[:H], g[H:]
            un = u[2 * H :].copy() if keep else u[2 * H :]
            n = r * un
            n += a[2 * H :]
            np.tanh(n, out=n)
            if keep:
                tape.append((t, h, z, r, un, n))
            h = np.subtract(h, n) if keep else np.subtract(h, n, out=h)
            h *= z
            h += n
            if not whole[t]:
                h *= mask[t]
            out[t] = h
        return out, tape

    def infer(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.forward(x, mask)[0]

    def backward(self, x, mask, tape, dout) -> dict[str, np.ndarray]:
        H = self.U.shape[1]
        dU, dA = np.zeros_like(self.U), np.empty((3 * H, x.size), self.U.dtype)
        dh = np.zeros((H, x.shape[1]), self.U.dtype)
        for t, h, z, r, un, n in reversed(tape):
            dh = (dh + dout[t]) * mask[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            d = np.concatenate([dz, dr, dn * r])
            dU += d @ h.T
            dA[:, t * x.shape[1] : (t + 1) * x.shape[1]] = np.concatenate([dz, dr, dn])
            dh = dh * z + self.U.T @ d
        return {f"T{self.tag}": _table_grad(len(self.table), x.ravel(), dA), f"U{self.tag}": dU}


class Lstm:
    """One direction of long short-term memory over codes (steps, rows); mask is 0 at padding."""

    gates = 4

    @classmethod
    def init(cls, rng, codes: int, hidden: int, tag: str) -> dict[str, np.ndarray]:
        f = np.float32
        table = rng.standard_normal((codes, 4 * hidden)) * 0.3
        table[:, hidden : 2 * hidden] += 1.0  # remember at first
        return {f"T{tag}": table.astype(f), f"U{tag}": (rng.standard_normal((4 * hidden, hidden)) / np.sqrt(hidden)).astype(f)}

    def __init__(self, params: dict[str, np.ndarray], tag: str, reverse: bool):
        self.table, self.U, self.tag, self.reverse = params[f"T{tag}"], params[f"U{tag}"], tag, reverse

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        steps, rows = x.shape
        H = self.U.shape[1]
        table = np.ascontiguousarray(self.table.T)
        out = np.empty((steps, H, rows), self.U.dtype)
        h, c = np.zeros((H, rows), self.U.dtype), np.zeros((H, rows), self.U.dtype)
        tape = []
        for t in range(steps - 1, -1, -1) if self.reverse else range(steps):
            a = np.take(table, x[t], axis=1, mode="clip")
            a += self.U @ h
            s = half_sigmoid(a[: 3 * H])
            g = np.tanh(a[3 * H :])
            i, f, o = s[:H], s[H : 2 * H], s[2 * H :]
            new = (f * c + i * g) * mask[t]
            tc = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tc))
            c, h = new, o * tc
            out[t] = h
        return out, tape

    def infer(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """What forward gives, without a tape: one tanh serves all gates, as sigmoid(a) = (1 + tanh(a / 2)) / 2."""
        steps, rows = x.shape
        H = self.U.shape[1]
        half = np.r_[np.full(3 * H, 0.5), np.ones(H)].astype(self.U.dtype)[:, None]
        table, U, whole = np.ascontiguousarray(self.table.T) * half, self.U * half, mask.all(axis=1)
        out = np.empty((steps, H, rows), self.U.dtype)
        h, c = np.zeros((H, rows), self.U.dtype), np.zeros((H, rows), self.U.dtype)
        a, u = np.empty((4 * H, rows), self.U.dtype), np.empty((4 * H, rows), self.U.dtype)
        for t in range(steps - 1, -1, -1) if self.reverse else range(steps):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            a += np.dot(U, h, out=u)
            np.tanh(a, out=a)
            gates = a[: 3 * H]
            gates += 1
            gates *= 0.5
            c *= a[H : 2 * H]
            c += np.multiply(a[:H], a[3 * H :], out=u[:H])
            if not whole[t]:
                c *= mask[t]
            h = np.multiply(a[2 * H : 3 * H], np.tanh(c, out=u[:H]), out=out[t])
        return out

    def backward(self, x, mask, tape, dout) -> dict[str, np.ndarray]:
        H = self.U.shape[1]
        dU, dA = np.zeros_like(self.U), np.empty((4 * H, x.size), self.U.dtype)
        dh, dc = np.zeros((H, x.shape[1]), self.U.dtype), np.zeros((H, x.shape[1]), self.U.dtype)
        for t, h, c, i, f, o, g, tc in reversed(tape):
            dh = dh + dout[t]
            do = dh * tc
            dnew = (dc + dh * o * (1 - tc * tc)) * mask[t]
            d = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)])
            dU += d @ h.T
            dA[:, t * x.shape[1] : (t + 1) * x.shape[1]] = d
            dh, dc = self.U.T @ d, dnew * f
        return {f"T{self.tag}": _table_grad(len(self.table), x.ravel(), dA), f"U{self.tag}": dU}


class Labeller:
    """A bidirectional network that gives scores (steps, labels, rows) for every position."""

    def __init__(self, cell, params: dict[str, np.ndarray]):
        self.params, self.cell = params, cell

    @classmethod
    def init(cls, cell, codes: int, hidden: int, labels: int, seed: int):
        rng = np.random.default_rng(seed)
        p = cell.init(rng, codes, hidden, "f") | cell.init(rng, codes, hidden, "b")
        p["V"] = (rng.standard_normal((labels, 2 * hidden)) * 0.3).astype(np.float32)
        p["c"] = np.zeros((labels, 1), np.float32)
        p["trans"] = np.zeros((labels, labels), np.float32)
        return cls(cell, p)

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = (self.cell(self.params, tag, tag == "b").infer(x, mask) for tag in "fb")
        H = f.shape[1]
        return np.matmul(self.params["V"][:, :H], f) + np.matmul(self.params["V"][:, H:], b) + self.params["c"]

    def gradients(self, x, mask, loss) -> tuple[float, dict[str, np.ndarray]]:
        """loss(scores) gives the value, its gradient by the scores and further gradients."""
        f, b = self.cell(self.params, "f", False), self.cell(self.params, "b", True)
        hf, tf = f.forward(x, mask, True)
        hb, tb = b.forward(x, mask, True)
        H, V = hf.shape[1], self.params["V"]
        value, ds, more = loss(np.matmul(V[:, :H], hf) + np.matmul(V[:, H:], hb) + self.params["c"])
        ds = ds.astype(V.dtype)
        g = {"V": np.concatenate([np.einsum("tkb,thb->kh", ds, hf), np.einsum("tkb,thb->kh", ds, hb)], axis=1), "c": ds.sum(axis=(0, 2))[:, None]}
        g |= f.backward(x, mask, tf, np.matmul(V[:, :H].T, ds)) | b.backward(x, mask, tb, np.matmul(V[:, H:].T, ds))
        return value, g | more


def softmax(s: np.ndarray) -> np.ndarray:
    """Over axis 1, in place."""
    s -= s.max(axis=1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=1, keepdims=True)
    return s


def crf_loss(scores: np.ndarray, trans: np.ndarray, labels: np.ndarray, mask: np.ndarray):
    """Mean negative log-likelihood of label paths, its gradients by scores and by trans.

    mask must be 1 up to a row's length and 0 after it. Forward and backward messages are probabilities,
    scaled to one at each step.
    """
    steps, K, rows = scores.shape
    e, on = scores.astype(np.float64), mask[:, None, :] > 0
    top = e.max(axis=1, keepdims=True)
    E, A = np.exp(e - top), np.exp(trans.astype(np.float64))
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((steps, 1, rows))
    for t in range(steps):
        new = E[0] if t == 0 else np.where(on[t], (A.T @ alpha[t - 1]) * E[t], alpha[t - 1])
        scale[t] = new.sum(axis=0)
        alpha[t] = new / scale[t]
    into = np.empty_like(e)
    for t in range(steps - 1, 0, -1):
        into[t] = E[t] * beta[t] / scale[t]
        beta[t - 1] = np.where(on[t], A @ into[t], beta[t])
    post = alpha * beta * mask[:, None, :]
    one = (labels[:, None, :] == np.arange(K)[None, :, None]) * mask[:, None, :]
    flat = lambda x: x.transpose(1, 0, 2).reshape(K, -1)
    pairs = A * (flat(alpha[:-1]) @ flat(into[1:] * on[1:]).T)
    seen = flat(one[:-1]) @ flat(one[1:]).T
    value = float(np.log(scale).sum() + (top * on).sum() - (one * e).sum() - (seen * trans).sum())
    n = max(1.0, float(mask.sum()))
    return value / n, (post - one) / n, (pairs - seen) / n


def viterbi(scores: np.ndarray, trans: np.ndarray, before: np.ndarray | float = 0.0, after: np.ndarray | float = 0.0, length: np.ndarray | None = None) -> np.ndarray:
    """Best label paths (steps, rows); before and after (labels, rows) are added at the ends of each path,
    length gives each row's number of steps (default: all)."""
    steps, K, rows = scores.shape
    back = np.zeros((steps, K, rows), np.int8)
    last = np.full(rows, steps) if length is None else length
    best = scores[0] + before
    end = np.where(last == 1, best, 0)
    for t in range(1, steps):
        both = best[:, None, :] + trans[:, :, None]
        back[t] = both.argmax(axis=0)
        best = both.max(axis=0) + scores[t]
        if length is not None:
            end = np.where(last == t + 1, best, end)
    end = (best if length is None else end) + after
    path, at, now = np.zeros((steps, rows), np.int8), np.arange(rows), end.argmax(axis=0)
    for t in range(steps - 1, -1, -1):
        inside = t < last
        path[t] = np.where(inside, now, 0)
        now = np.where(inside & (t > 0), back[t, now, at], now)
    return path
