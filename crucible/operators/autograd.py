"""Reverse-mode differentiation over numpy arrays: as many operations as the encoder and its losses need."""

from __future__ import annotations

import numpy as np


def _unbroadcast(g: np.ndarray, shape: tuple) -> np.ndarray:
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(axis=i, keepdims=True)
    return g


def sum_by(x: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
    """Rows of x added up by segment: first rows of all segments, then second ones, and so on; by a product where a segment has many rows."""
    out = np.zeros((n, *x.shape[1:]))
    if not len(segment):
        return out
    if x.ndim == 1:
        return np.bincount(segment, weights=x, minlength=n)
    count = np.bincount(segment, minlength=n)
    if count.max() > 64 and n * len(segment) <= 1 << 22:
        hit = np.zeros((n, len(segment)))
        hit[segment, np.arange(len(segment))] = 1.0
        return hit @ x
    order = np.argsort(segment, kind="stable")
    begin = np.cumsum(count) - count
    live = np.flatnonzero(count)
    for k in range(int(count.max())):
        live = live[count[live] > k]
        out[live] += x[order[begin[live] + k]]
    return out


class T:
    """A value and how it came about."""

    __slots__ = ("v", "g", "up", "back", "wants")

    def __init__(self, v, up=(), back=None, wants=False):
        self.v, self.g, self.up, self.back = np.asarray(v, dtype=np.float64), None, up, back
        self.wants = wants or any(u.wants for u in up)

    @property
    def shape(self):
        return self.v.shape

    def add_grad(self, g):
        g = _unbroadcast(g, self.v.shape)
        self.g = g if self.g is None else self.g + g

    def __add__(self, o):
        o = o if isinstance(o, T) else T(o)
        return T(self.v + o.v, (self, o), lambda g: (g, g))

    __radd__ = __add__

    def __neg__(self):
        return T(-self.v, (self,), lambda g: (-g,))

    def __sub__(self, o):
        return self + (-(o if isinstance(o, T) else T(o)))

    def __rsub__(self, o):
        return T(o) + (-self)

    def __mul__(self, o):
        o = o if isinstance(o, T) else T(o)
        return T(self.v * o.v, (self, o), lambda g: (g * o.v, g * self.v))

    __rmul__ = __mul__

    def __truediv__(self, o):
        o = o if isinstance(o, T) else T(o)
        return T(self.v / o.v, (self, o), lambda g: (g / o.v, -g * self.v / o.v**2))

    def __matmul__(self, o):
        return T(self.v @ o.v, (self, o), lambda g: (g @ o.v.T, self.v.T @ g))

    def t(self):
        return T(self.v.T, (self,), lambda g: (g.T,))

    def __getitem__(self, i):
        def back(g):
            if isinstance(i, np.ndarray) and i.ndim == 1 and i.dtype.kind == "i":
                return (sum_by(g, i, len(self.v)),)
            out = np.zeros_like(self.v)
            np.add.at(out, i, g)
            return (out,)

        return T(self.v[i], (self,), back)

    def reshape(self, *s):
        return T(self.v.reshape(*s), (self,), lambda g: (g.reshape(self.v.shape),))

    def sum(self, axis=None, keepdims=False):
        def back(g):
            g = g if keepdims or axis is None else np.expand_dims(g, axis)
            return (np.broadcast_to(g, self.v.shape),)

        return T(self.v.sum(axis=axis, keepdims=keepdims), (self,), back)

    def mean(self, axis=None, keepdims=False):
        n = self.v.size if axis is None else self.v.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)


def relu(x: T) -> T:
    return T(np.maximum(x.v, 0), (x,), lambda g: (g * (x.v > 0),))


def sqrt(x: T) -> T:
    out = np.sqrt(x.v)
    return T(out, (x,), lambda g: (g / (2 * out),))


def exp(x: T) -> T:
    out = np.exp(x.v)
    return T(out, (x,), lambda g: (g * out,))


def log(x: T) -> T:
    return T(np.log(x.v), (x,), lambda g: (g / x.v,))


def log1p_exp(x: T) -> T:
    """log(1 + exp(x)) without overflow."""
    return T(np.logaddexp(0, x.v), (x,), lambda g: (g / (1 + np.exp(-x.v)),))


def concat(parts: list[T]) -> T:
    """Along the last axis."""
    at = np.cumsum([p.v.shape[-1] for p in parts])[:-1]
    return T(np.concatenate([p.v for p in parts], axis=-1), tuple(parts), lambda g: tuple(np.split(g, at, axis=-1)))


def where(mask, a: T, b: T) -> T:
    return T(np.where(mask, a.v, b.v), (a, b), lambda g: (np.where(mask, g, 0), np.where(mask, 0, g)))


def segment_sum(x: T, segment: np.ndarray, n: int) -> T:
    return T(sum_by(x.v, segment, n), (x,), lambda g: (g[segment],))


def segment_softmax(scores: T, segment: np.ndarray, n: int, least: float = 1e-12) -> T:
    """Shares of one-dimensional scores in their segment."""
    if scores.v.ndim != 1:
        raise ValueError("scores must have one dimension")
    top = np.full(n, -np.inf)
    np.maximum.at(top, segment, scores.v)
    e = exp(scores - T(top[segment]))
    total = segment_sum(e, segment, n)
    return e / T(np.maximum(total.v, least), (total,), lambda g: (g * (total.v > least),))[segment]


def log_sum_exp(x: T) -> T:
    """Over the last axis."""
    top = x.v.max(axis=-1, keepdims=True)
    return log(exp(x - T(top)).sum(axis=-1)) + T(top[..., 0])


def layer_norm(x: T, gain: T, shift: T, eps: float = 1e-5) -> T:
    d = x - x.mean(axis=-1, keepdims=True)
    return d / sqrt((d * d).mean(axis=-1, keepdims=True) + eps) * gain + shift


def unit(x: T, least: float = 1e-12) -> T:
    n = sqrt((x * x).sum(axis=-1, keepdims=True) + least**2)
    return x / n


def backward(loss: T) -> None:
    """Fill .g of all that loss depends on."""
    order, seen, todo = [], set(), [(loss, False)]
    while todo:
        x, done = todo.pop()
        if done:
            order.append(x)
        elif id(x) not in seen and x.wants:
            seen.add(id(x))
            todo.append((x, True))
            todo += [(u, False) for u in x.up]
    loss.g = np.ones_like(loss.v)
    for x in reversed(order):
        if x.back is not None and x.g is not None:
            for u, g in zip(x.up, x.back(x.g), strict=True):
                if u.wants:
                    u.add_grad(g)
