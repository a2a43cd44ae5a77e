"""Forward passes of the two embedding towers in numpy, one block of rows at a time.

Shapes: B rows, M metapaths, C channels, H heads.  Weights are plain arrays in a dict, so that a
broadcast carries them; nothing here depends on a training framework.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.plans.session import ship

ACTIVATIONS = {
    "none": lambda x: x,
    "relu": lambda x: np.maximum(x, 0),
    "leaky_relu": lambda x: np.where(x > 0, x, 0.2 * x),
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
}


@dataclass
class PaperTower:
    """Fusion of metapath vectors into one unit vector.

    ``feat_keys`` are taken in sorted order.  ``use_mlp`` puts ``n_fp_layers`` per-metapath affine
    layers, each with a joint layer norm and a PReLU, before the attention.
    """

    feat_keys: list[str]
    nfeat: int
    hidden: int
    embed_dim: int
    n_fp_layers: int = 1
    num_heads: int = 1
    act: str = "none"
    residual: bool = True
    use_mlp: bool = False
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.feat_keys = sorted(self.feat_keys)
        if self.act not in ACTIVATIONS:
            raise ValueError(f"unknown activation {self.act!r}")
        if self.width % self.num_heads:
            raise ValueError("the channels must divide evenly among the heads")
        if self.use_mlp and self.n_fp_layers < 1:
            raise ValueError("at least one projection layer is needed")

    @property
    def width(self) -> int:
        return self.hidden if self.use_mlp else self.nfeat

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Name and shape of every parameter."""
        m, c = len(self.feat_keys), self.width
        out: dict[str, tuple[int, ...]] = {}
        if self.use_mlp:
            for k in range(self.n_fp_layers):
                cin = self.nfeat if k == 0 else self.hidden
                out |= {f"fp{k}.w": (m, cin, self.hidden), f"fp{k}.b": (m, self.hidden)}
                out |= {f"fp{k}.scale": (m, self.hidden), f"fp{k}.shift": (m, self.hidden), f"fp{k}.slope": (1,)}
        for name in ("query", "key", "value"):
            out |= {f"{name}.w": (c, c), f"{name}.b": (c,)}
        out |= {"gamma": (1,), "concat.w": (m * c, self.hidden), "concat.b": (self.hidden,)}
        if self.residual:
            out["residual.w"] = (self.nfeat, self.hidden)
        return out | {"head.w": (self.hidden, self.embed_dim), "head.b": (self.embed_dim,)}

    def parameter_count(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes().values())

    def initialise(self, seed: int = 42) -> PaperTower:
        """Xavier-uniform matrices, zero biases, unit scales; the attention starts as the identity."""
        rng = np.random.default_rng(seed)
        for name, shape in self.shapes().items():
            if name.endswith(".w"):
                bound = np.sqrt(2.0) * np.sqrt(6.0 / (shape[-2] + shape[-1]))
                self.weights[name] = rng.uniform(-bound, bound, shape)
            else:
                self.weights[name] = np.full(shape, {"scale": 1.0, "slope": 0.25}.get(name.rpartition(".")[2], 0.0))
        return self

    def forward(self, features: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """[B, M, nfeat] to unit vectors [B, embed_dim]."""
        w = self.weights
        x, plain = features, features.mean(axis=1)
        if self.use_mlp:
            for k in range(self.n_fp_layers):
                x = np.einsum("bmi,mio->bmo", x, w[f"fp{k}.w"]) + w[f"fp{k}.b"]
                centred = x - x.mean(axis=(1, 2), keepdims=True)
                x = centred / np.sqrt((centred**2).mean(axis=(1, 2), keepdims=True) + 1e-5) * w[f"fp{k}.scale"] + w[f"fp{k}.shift"]
                x = np.where(x > 0, x, w[f"fp{k}.slope"] * x)
        x = self._attend(x, mask)
        y = x.reshape(len(x), -1) @ w["concat.w"] + w["concat.b"]
        if self.residual:
            y = y + plain @ w["residual.w"]
        return unit(y @ w["head.w"] + w["head.b"])

    def _attend(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        b, m, c = x.shape
        q, k, v = ((x @ self.weights[f"{n}.w"] + self.weights[f"{n}.b"]).reshape(b, m, self.num_heads, -1).transpose(0, 2, 1, 3) for n in ("query", "key", "value"))
        score = ACTIVATIONS[self.act](q @ k.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1]))
        score = np.exp(score - score.max(axis=-1, keepdims=True))
        share = score / score.sum(axis=-1, keepdims=True)
        if mask is not None:
            share = share * mask[:, None, None, :]
            share = share / (share.sum(axis=-1, keepdims=True) + 1e-12)
        mixed = self.weights["gamma"] * (share @ v)
        return mixed.transpose(0, 2, 1, 3).reshape(b, m, c) + x


@dataclass
class ContextTower:
    """Projection of an encoded passage: affine map, layer norm, unit length.

    ``tuned`` puts a linear layer on the encoder's output, at first the identity, which training
    moves at the encoder's own rate.
    """

    nfeat: int
    embed_dim: int
    tuned: bool = False
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def initialise(self, seed: int = 42) -> ContextTower:
        rng = np.random.default_rng(seed)
        bound = np.sqrt(2.0) * np.sqrt(6.0 / (self.nfeat + self.embed_dim))
        self.weights = {
            "proj.w": rng.uniform(-bound, bound, (self.nfeat, self.embed_dim)), "proj.b": np.zeros(self.embed_dim),
            "norm.scale": np.ones(self.embed_dim), "norm.shift": np.zeros(self.embed_dim),
        }
        if self.tuned:
            self.weights["encoder.w"] = np.eye(self.nfeat)
        return self

    def forward(self, passages: np.ndarray) -> np.ndarray:
        w = self.weights
        if self.tuned:
            passages = passages @ w["encoder.w"]
        x = passages @ w["proj.w"] + w["proj.b"]
        x = x - x.mean(axis=1, keepdims=True)
        x = x / np.sqrt((x**2).mean(axis=1, keepdims=True) + 1e-5)
        return unit(x * w["norm.scale"] + w["norm.shift"])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def embed(df: DataFrame, tower: PaperTower | ContextTower, id_col: str, vec_cols: list[str], out: str = "emb") -> DataFrame:
    """(id, unit vector) of every row; Arrow batches go through the tower's forward pass."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(tower)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = [matrix(batch.column(k + 1)) for k in range(len(vec_cols))]
            made = model.forward(np.stack(blocks, axis=1) if isinstance(model, PaperTower) else blocks[0])
            values = pa.array(made.reshape(-1), pa.float64())
            offsets = pa.array(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], [id_col, out])

    return df.select(F.col(id_col), *[F.col(c).cast("array<double>") for c in vec_cols]).mapInArrow(run, f"`{id_col}` {id_type}, `{out}` array<double>")
