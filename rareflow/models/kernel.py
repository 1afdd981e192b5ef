"""Per-task arithmetic of the adversarial classifier: losses and their gradients.

Only what a task does with one batch of rows lives here; distributing rows,
merging weights and scoring tables is Spark's work (see ``dan.py``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Fixed value: a normalisation layer that never updates its statistics divides by
# the root of one plus its epsilon.
NORM = float(1.0 / np.sqrt(1.0 + 1e-3))

ACTIVATIONS = {  # name: (value, derivative given input and value)
    "relu": (lambda z: np.maximum(z, 0.0), lambda z, a: (z > 0).astype(z.dtype)),
    "sigmoid": (lambda z: 1.0 / (1.0 + np.exp(-z)), lambda z, a: a * (1.0 - a)),
    "tanh": (np.tanh, lambda z, a: 1.0 - a * a),
    "elu": (lambda z: np.where(z > 0, z, np.expm1(np.minimum(z, 0.0))),
            lambda z, a: np.where(z > 0, 1.0, a + 1.0)),
}


@dataclass(frozen=True)
class Shape:
    """Architecture. ``disguise`` None means a plain classifier; ``index_map``
    gives the cardinality of the category codes at input positions. The embeddings at ``stored``
    positions are rows of a table (see ``stored.py``) and no weights of the model. The disguise takes
    the activation and normalisation of the discriminator unless it has its own."""

    num_inputs: int
    discriminator: tuple[int, ...] = ()
    disguise: tuple[int, ...] | None = None
    activation: str = "relu"
    batch_norm: bool = True
    index_map: dict[int, int] = field(default_factory=dict)
    alpha: float = 3.0
    stored: tuple[int, ...] = ()
    disguise_activation: str | None = None
    disguise_batch_norm: bool | None = None

    def activation_of(self, net: str) -> str:
        own = self.disguise_activation if net == "t" else None
        return self.activation if own is None else own

    def normalises(self, net: str) -> bool:
        own = self.disguise_batch_norm if net == "t" else None
        return self.batch_norm if own is None else own

    def embedding_dim(self, cardinality: int) -> int:
        return int(np.ceil(cardinality ** (1.0 / self.alpha) - 1e-9))

    @property
    def width(self) -> int:
        """Width after embedding."""
        return (self.num_inputs - len(self.index_map)
                + sum(self.embedding_dim(c) for c in self.index_map.values()))

    @property
    def size(self) -> int:
        """Number of weights."""
        return sum(int(np.prod(dims)) for _, dims in self.blocks())

    def blocks(self) -> list[tuple[str, tuple[int, ...]]]:
        """Name and shape of every weight block, in storage order."""
        out = [(f"e{p}", (c, self.embedding_dim(c))) for p, c in sorted(self.index_map.items())
               if p not in self.stored]
        nets = [("d", self.discriminator, 2)]
        if self.disguise is not None:
            nets.append(("t", self.disguise, self.width))
        for net, hidden, outputs in nets:
            sizes = [self.width, *hidden, outputs]
            for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
                out += [(f"{net}{i}w", (a, b)), (f"{net}{i}b", (b,))]
                if self.normalises(net) and i < len(hidden):
                    out += [(f"{net}{i}g", (b,)), (f"{net}{i}s", (b,))]
        return out


def initial_weights(shape: Shape, seed: int = 0) -> np.ndarray:
    """Uniform Glorot matrices, zero offsets, unit gains."""
    rng, parts = np.random.default_rng(seed), []
    for name, dims in shape.blocks():
        if len(dims) == 2:
            edge = np.sqrt(6.0 / sum(dims))
            parts.append(rng.uniform(-edge, edge, dims).ravel())
        else:
            parts.append(np.full(dims, 1.0 if name.endswith("g") else 0.0))
    return np.concatenate(parts)


def as_blocks(shape: Shape, flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views into a flat weight or gradient vector."""
    out, at = {}, 0
    for name, dims in shape.blocks():
        size = int(np.prod(dims))
        out[name] = flat[at:at + size].reshape(dims)
        at += size
    return out


def disguise_mask(shape: Shape) -> np.ndarray:
    """True at the weights of the disguise network."""
    return np.concatenate([np.full(int(np.prod(d)), n.startswith("t"))
                           for n, d in shape.blocks()])


Given = dict[int, np.ndarray]        # vectors of stored positions, a row per row


def embed(shape: Shape, w: dict, x: np.ndarray, given: Given | None = None) -> np.ndarray:
    if not shape.index_map:
        return x
    plain = [i for i in range(shape.num_inputs) if i not in shape.index_map]
    vectors = [given[p] if p in shape.stored else w[f"e{p}"][x[:, p].astype(int)]
               for p in sorted(shape.index_map)]
    return np.concatenate([x[:, plain], *vectors], axis=1)


def _embed_back(shape: Shape, x: np.ndarray, dx: np.ndarray, grad: dict) -> Given:
    """Adds to the embeddings' gradients; returns those of stored vectors, row by row."""
    at, stored = shape.num_inputs - len(shape.index_map), {}
    for p, cardinality in sorted(shape.index_map.items()):
        size = shape.embedding_dim(cardinality)
        if p in shape.stored:
            stored[p] = dx[:, at:at + size]
        else:
            np.add.at(grad[f"e{p}"], x[:, p].astype(int), dx[:, at:at + size])
        at += size
    return stored


def _forward(shape: Shape, w: dict, net: str, x: np.ndarray):
    hidden = shape.discriminator if net == "d" else shape.disguise
    value = ACTIVATIONS[shape.activation_of(net)][0]
    tape = []
    for i in range(len(hidden)):
        z = x @ w[f"{net}{i}w"] + w[f"{net}{i}b"]
        a = value(z)
        tape.append((x, z, a))
        x = a * NORM * w[f"{net}{i}g"] + w[f"{net}{i}s"] if shape.normalises(net) else a
    tape.append((x, None, None))
    last = len(hidden)
    return x @ w[f"{net}{last}w"] + w[f"{net}{last}b"], tape


def _backward(shape: Shape, w: dict, net: str, tape: list, dout: np.ndarray,
              grad: dict | None) -> np.ndarray:
    """Gradient at the network's input; weight gradients go into ``grad`` if given."""
    slope = ACTIVATIONS[shape.activation_of(net)][1]
    for i in range(len(tape) - 1, -1, -1):
        x, z, a = tape[i]
        if z is not None:
            if shape.normalises(net):
                if grad is not None:
                    grad[f"{net}{i}g"] += (dout * a * NORM).sum(axis=0)
                    grad[f"{net}{i}s"] += dout.sum(axis=0)
                dout = dout * NORM * w[f"{net}{i}g"]
            dout = dout * slope(z, a)
        if grad is not None:
            grad[f"{net}{i}w"] += x.T @ dout
            grad[f"{net}{i}b"] += dout.sum(axis=0)
        dout = dout @ w[f"{net}{i}w"].T
    return dout


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    shifted = logits - logits.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def positive_probability(shape: Shape, w: dict, x: np.ndarray, embedded: bool = False,
                         given: Given | None = None) -> np.ndarray:
    h = x if embedded else embed(shape, w, x, given)
    return np.exp(_log_softmax(_forward(shape, w, "d", h)[0]))[:, 1]


def disguised(shape: Shape, w: dict, x: np.ndarray) -> np.ndarray:
    """Negative rows after the disguise, in embedded space."""
    return _forward(shape, w, "t", embed(shape, w, x))[0]


def labelled_terms(shape: Shape, w: dict, x: np.ndarray, y: np.ndarray):
    """(sum of cross entropies, its gradient) over the rows."""
    return labelled_parts(shape, w, x, y)[:2]


def labelled_parts(shape: Shape, w: dict, x: np.ndarray, y: np.ndarray,
                   given: Given | None = None):
    """``labelled_terms`` and each row's gradient of its stored vectors."""
    flat = np.zeros(shape.size, dtype=x.dtype)
    grad = as_blocks(shape, flat)
    logits, tape = _forward(shape, w, "d", embed(shape, w, x, given))
    logp = _log_softmax(logits)
    rows, y = np.arange(len(y)), y.astype(int)
    dlogits = np.exp(logp)
    dlogits[rows, y] -= 1.0
    dx = _backward(shape, w, "d", tape, dlogits, grad)
    return -logp[rows, y].sum(), flat, _embed_back(shape, x, dx, grad)


def disguise_terms(shape: Shape, w: dict, x: np.ndarray, lambd: float, eta: float):
    """Sums over negative rows: (entropy, log quality, L1 change, successes, gradient).

    The gradient holds eta * entropy for discriminator and embeddings, and the
    disguise loss for the disguise network; each network's loss moves only its
    own weights.
    """
    return disguise_parts(shape, w, x, lambd, eta)[:5]


def disguise_parts(shape: Shape, w: dict, x: np.ndarray, lambd: float, eta: float,
                   given: Given | None = None):
    """``disguise_terms`` and each row's gradient of its stored vectors."""
    flat = np.zeros(shape.size, dtype=x.dtype)
    grad = as_blocks(shape, flat)
    h = embed(shape, w, x, given)
    t, t_tape = _forward(shape, w, "t", h)
    logits, d_tape = _forward(shape, w, "d", t)
    logp = _log_softmax(logits)
    p = np.exp(logp)
    entropy = -(p * logp).sum(axis=1)
    # discriminator side
    d_entropy = -eta * p * (logp + entropy[:, None])
    dt = _backward(shape, w, "d", d_tape, d_entropy, grad)
    dh = _backward(shape, w, "t", t_tape, dt, None)
    stored = _embed_back(shape, x, dh, grad)
    # disguise side
    d_quality = p.copy()
    d_quality[:, 1] -= 1.0
    dt = _backward(shape, w, "d", d_tape, d_quality, None) + lambd * np.sign(t - h)
    _backward(shape, w, "t", t_tape, dt, grad)
    return (entropy.sum(), logp[:, 1].sum(), np.abs(t - h).sum(), (p[:, 1] >= 0.5).sum(), flat,
            stored)


@dataclass
class Adam:
    """Adam steps on a flat weight vector."""

    rate: float = 1e-3
    first: float = 0.9
    second: float = 0.999
    eps: float = 1e-8
    steps: int = 0
    m: np.ndarray | float = 0.0
    v: np.ndarray | float = 0.0

    def copied(self, size: int, dtype: str) -> Adam:
        """The same state with moments of its own, as vectors."""
        return Adam(self.rate, self.first, self.second, self.eps, self.steps,
                    np.zeros(size, dtype) + np.asarray(self.m, dtype),
                    np.zeros(size, dtype) + np.asarray(self.v, dtype))

    def step(self, weights: np.ndarray, grad: np.ndarray) -> None:
        self.steps += 1
        self.m = self.first * self.m + (1 - self.first) * grad
        self.v = self.second * self.v + (1 - self.second) * grad * grad
        rate = self.rate * (1 - self.second**self.steps) ** 0.5 / (1 - self.first**self.steps)
        weights -= rate * self.m / (np.sqrt(self.v) + self.eps)
