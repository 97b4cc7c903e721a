"""Reverse-mode differentiation over NumPy arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _shaped(grad: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """``grad`` summed over the axes that broadcasting added."""
    while grad.ndim > len(shape):
        grad = grad.sum(0)
    for i, n in enumerate(shape):
        if n == 1 and grad.shape[i] != 1:
            grad = grad.sum(i, keepdims=True)
    return grad


class Tensor:
    """An array that remembers how it was made."""

    __array_priority__ = 100

    def __init__(self, data, parents: tuple[Tensor, ...] = (), pull: Callable | None = None):
        self.data = np.asarray(data, float)
        self.parents, self.pull, self.grad = parents, pull, None

    @property
    def shape(self):
        return self.data.shape

    def backward(self) -> None:
        order, seen = [], set()
        stack = [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p in node.parents]
        self.grad = np.ones_like(self.data)
        for node in reversed(order):
            if node.pull is None or node.grad is None:
                continue
            for parent, g in zip(node.parents, node.pull(node.grad), strict=True):
                if g is not None:
                    g = _shaped(g, parent.shape)
                    parent.grad = g if parent.grad is None else parent.grad + g

    def __add__(self, o):
        o = lift(o)
        return Tensor(self.data + o.data, (self, o), lambda g: (g, g))

    def __mul__(self, o):
        o = lift(o)
        return Tensor(self.data * o.data, (self, o), lambda g: (g * o.data, g * self.data))

    def __sub__(self, o):
        o = lift(o)
        return Tensor(self.data - o.data, (self, o), lambda g: (g, -g))

    def __truediv__(self, o):
        o = lift(o)
        return Tensor(self.data / o.data, (self, o), lambda g: (g / o.data, -g * self.data / o.data**2))

    def __matmul__(self, o):
        return Tensor(self.data @ o.data, (self, o), lambda g: (g @ o.data.T, self.data.T @ g))

    def __neg__(self):
        return self * -1.0

    def __radd__(self, o):
        return self + o

    def __rmul__(self, o):
        return self * o

    def __rsub__(self, o):
        return lift(o) - self

    def __rtruediv__(self, o):
        return lift(o) / self

    def __getitem__(self, at):
        def pull(g):
            out = np.zeros_like(self.data)
            np.add.at(out, at, g)
            return (out,)

        return Tensor(self.data[at], (self,), pull)

    @property
    def T(self):
        return Tensor(self.data.T, (self,), lambda g: (g.T,))

    def sum(self, axis=None, keepdims=False):
        def pull(g):
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return (np.broadcast_to(g, self.shape).copy(),)

        return Tensor(self.data.sum(axis, keepdims=keepdims), (self,), pull)

    def mean(self, axis=None, keepdims=False):
        n = self.data.size if axis is None else self.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)


def lift(x) -> Tensor:
    return x if isinstance(x, Tensor) else Tensor(x)


def _unary(f: Callable, slope: Callable) -> Callable[[Tensor], Tensor]:
    def apply(x: Tensor) -> Tensor:
        x = lift(x)
        y = f(x.data)
        return Tensor(y, (x,), lambda g: (g * slope(x.data, y),))

    return apply


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


exp = _unary(lambda x: np.exp(np.clip(x, -60, 60)), lambda x, y: y)
log = _unary(np.log, lambda x, y: 1 / x)
sqrt = _unary(np.sqrt, lambda x, y: 0.5 / y)
absolute = _unary(np.abs, lambda x, y: np.sign(x))
sigmoid = _unary(_sigmoid, lambda x, y: y * (1 - y))
tanh = _unary(np.tanh, lambda x, y: 1 - y * y)
relu = _unary(lambda x: np.maximum(x, 0), lambda x, y: (x > 0).astype(float))
softplus = _unary(lambda x: np.logaddexp(0, x), lambda x, y: _sigmoid(x))
elu = _unary(lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))), lambda x, y: np.where(x > 0, 1.0, y + 1))
leaky_relu = _unary(lambda x: np.where(x > 0, x, 0.01 * x), lambda x, y: np.where(x > 0, 1.0, 0.01))
# The two constants of self-normalising units.
SELU_SCALE, SELU_ALPHA = 1.0507009873554805, 1.6732632423543772
selu = _unary(lambda x: SELU_SCALE * np.where(x > 0, x, SELU_ALPHA * np.expm1(np.minimum(x, 0))), lambda x, y: np.where(x > 0, SELU_SCALE, y + SELU_SCALE * SELU_ALPHA))


def glu(x: Tensor) -> Tensor:
    """The first half of the columns gated by the second."""
    half = x.shape[1] // 2
    return x[:, :half] * sigmoid(x[:, half : 2 * half])


ACTIVATIONS = {"ReLU": relu, "Softplus": softplus, "Tanh": tanh, "SELU": selu, "LeakyReLU": leaky_relu, "Sigmoid": sigmoid, "ELU": elu, "GLU": glu}


def activation(name: str) -> Callable[[Tensor], Tensor]:
    """By name; an unknown name is an ELU."""
    return ACTIVATIONS.get(name, elu)


def square(x: Tensor) -> Tensor:
    return x * x


def clip(x: Tensor, low: float, high: float) -> Tensor:
    inside = (x.data >= low) & (x.data <= high)
    return Tensor(np.clip(x.data, low, high), (x,), lambda g: (g * inside,))


def safe_sqrt(x: Tensor) -> Tensor:
    return sqrt(clip(x, 1e-12, np.inf))


def concat(parts: list[Tensor], axis: int = 1) -> Tensor:
    parts = [lift(p) for p in parts]
    cuts = np.cumsum([p.shape[axis] for p in parts])[:-1]
    return Tensor(np.concatenate([p.data for p in parts], axis), tuple(parts), lambda g: tuple(np.split(g, cuts, axis)))


def log_softmax(x: Tensor, axis: int = 1) -> Tensor:
    top = x.data.max(axis, keepdims=True)
    z = x - top
    return z - log(exp(z).sum(axis, keepdims=True))


def softmax(x: Tensor, axis: int = 1) -> Tensor:
    return exp(log_softmax(x, axis))


def bce(logits: Tensor, label: np.ndarray) -> Tensor:
    """Binary cross-entropy of logits, per entry."""
    return softplus(logits) - logits * label
