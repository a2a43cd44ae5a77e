"""Reverse-mode differentiation of numpy expressions: just enough for the two towers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _fold(grad: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum a gradient over the axes along which a value was broadcast."""
    while grad.ndim > len(shape):
        grad = grad.sum(axis=0)
    for axis, n in enumerate(shape):
        if n == 1 and grad.shape[axis] != 1:
            grad = grad.sum(axis=axis, keepdims=True)
    return grad


class Var:
    """A value that remembers how its gradient reaches what it was made from."""

    def __init__(self, value, parents: tuple[tuple[Var, Callable[[np.ndarray], np.ndarray]], ...] = ()) -> None:
        self.value = np.asarray(value, dtype=np.float64)
        self.parents = parents
        self.grad: np.ndarray | None = None

    def __add__(self, other) -> Var:
        other = lift(other)
        return Var(self.value + other.value, ((self, lambda g: g), (other, lambda g: g)))

    def __neg__(self) -> Var:
        return Var(-self.value, ((self, lambda g: -g),))

    def __sub__(self, other) -> Var:
        return self + -lift(other)

    def __mul__(self, other) -> Var:
        other = lift(other)
        return Var(self.value * other.value, ((self, lambda g: g * other.value), (other, lambda g: g * self.value)))

    def __truediv__(self, other) -> Var:
        return self * lift(other).power(-1.0)

    def __matmul__(self, other) -> Var:
        other = lift(other)
        flip = lambda x: np.swapaxes(x, -1, -2)
        return Var(self.value @ other.value, ((self, lambda g: g @ flip(other.value)), (other, lambda g: flip(self.value) @ g)))

    def power(self, k: float) -> Var:
        return Var(self.value**k, ((self, lambda g: g * k * self.value ** (k - 1)),))

    def exp(self) -> Var:
        e = np.exp(self.value)
        return Var(e, ((self, lambda g: g * e),))

    def log(self) -> Var:
        return Var(np.log(self.value), ((self, lambda g: g / self.value),))

    def rectify(self, slope) -> Var:
        """``x`` where positive, else ``slope * x``; the slope may be learned."""
        slope = lift(slope)
        up = self.value > 0
        return Var(np.where(up, self.value, slope.value * self.value), ((self, lambda g: g * np.where(up, 1.0, slope.value)), (slope, lambda g: g * np.where(up, 0.0, self.value))))

    def sigmoid(self) -> Var:
        s = 1 / (1 + np.exp(-self.value))
        return Var(s, ((self, lambda g: g * s * (1 - s)),))

    def sum(self, axis=None) -> Var:
        """Sum that keeps its axes."""
        return Var(self.value.sum(axis=axis, keepdims=True), ((self, lambda g: np.broadcast_to(g, self.value.shape)),))

    def mean(self, axis) -> Var:
        total = self.sum(axis)
        return total * (total.value.size / self.value.size)

    def reshape(self, *shape: int) -> Var:
        return Var(self.value.reshape(shape), ((self, lambda g: g.reshape(self.value.shape)),))

    def transpose(self, *axes: int) -> Var:
        back = np.argsort(axes)
        return Var(self.value.transpose(axes), ((self, lambda g: g.transpose(back)),))

    def softmax(self) -> Var:
        e = (self - self.value.max(axis=-1, keepdims=True)).exp()
        return e / e.sum(-1)

    def unit(self) -> Var:
        return self / ((self * self).sum(-1) + 1e-24).power(0.5)

    def backward(self) -> None:
        """Set ``grad`` of everything that a scalar was made from."""
        order: list[Var] = []
        seen: set[int] = set()
        stack = [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p, _ in node.parents]
        self.grad = np.ones_like(self.value)
        for node in reversed(order):
            for parent, back in node.parents:
                g = _fold(back(node.grad), parent.value.shape)
                parent.grad = g if parent.grad is None else parent.grad + g


def lift(x) -> Var:
    return x if isinstance(x, Var) else Var(x)
