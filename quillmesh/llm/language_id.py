"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on fixed-length byte windows
and labels every byte position of a text; a document's probabilities are the mean over its
positions.  A text is cut into windows, with a warm-up on either side so that states have
settled where positions count, and windows of equal length run through the network together:
memory follows the batch, not the text.

Learning uses at most ``MAX_PER_LANGUAGE`` ids of each language that there is, in the order of a
hash, and from each ``CUTS`` stretches of ``CUT`` characters drawn from all over its text (of several
texts of one id and language, that of the least hash).  Prediction covers every byte of every text.

Nulls and edges: null texts and texts without a letter are ``und`` with score 0; rows with a
null language, text or id never teach; with no teaching rows everything is ``und``; repeated rows
are predicted alike; equal probabilities go to the first language in code-point order.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import held_out, materialize, ship

UNKNOWN = "und"
MAX_PER_LANGUAGE = 400
#: Stretches of a teaching text, and their characters.
CUTS, CUT = 16, 160
#: Shares of a language in which ids are ranked before the shares' best meet.
SHARES = 64
#: Teaching ids that may be broadcast (16 MB).
BROADCAST_IDS = 500_000
HIDDEN = 8
WINDOW = 224
WARM_UP = 16
BATCH = 2_048
LETTER = regex.compile(r"\p{L}")


class Network(NamedTuple):
    """``table`` holds the input's part of the three gates for every byte, for both directions."""

    languages: list[str]
    table: np.ndarray  # [2, 257, 3 * HIDDEN], the last row is the padding's
    recur: np.ndarray  # [2, HIDDEN, 3 * HIDDEN]
    out: np.ndarray  # [2 * HIDDEN, languages]
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(net: Network, d: int, codes: np.ndarray) -> np.ndarray:
    """Hidden states [T, B, H] of one direction; codes is [T, B]."""
    steps, batch = codes.shape
    h = np.zeros((batch, HIDDEN), dtype=np.float32)
    out = np.empty((steps, batch, HIDDEN), dtype=np.float32)
    table, recur = net.table[d], net.recur[d]
    gates, cand = np.ascontiguousarray(recur[:, : 2 * HIDDEN]), np.ascontiguousarray(recur[:, 2 * HIDDEN :])
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        x = table[codes[t]]
        g = x[:, : 2 * HIDDEN] + h @ gates
        np.multiply(g, 0.5, out=g)
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ cand)
        h = n + z * (h - n)
        out[t] = h
    return out


def _windows(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, first and end of the positions that count) of a text's windows."""
    if len(raw) <= WINDOW:
        return [(0, len(raw), 0, len(raw))]
    inner = WINDOW - 2 * WARM_UP
    out = []
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + inner)
        start = max(0, min(at - WARM_UP, len(raw) - WINDOW))
        out.append((start, start + WINDOW, at, stop))
        at = stop
    return out


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probability of each language over all positions of each text."""
    cuts = [(k, *w) for k, raw in enumerate(texts) for w in _windows(raw) if raw]
    cuts.sort(key=lambda c: c[2] - c[1])
    total = np.zeros((len(texts), len(net.languages)))
    for lo in range(0, len(cuts), BATCH):
        part = cuts[lo : lo + BATCH]
        steps = max(e - s for _, s, e, _, _ in part)
        codes = np.full((len(part), steps), 256, dtype=np.int64)
        counts = np.zeros((len(part), steps), dtype=np.float32)
        for j, (k, s, e, a, b) in enumerate(part):
            codes[j, : e - s] = np.frombuffer(texts[k], dtype=np.uint8)[s:e]
            counts[j, a - s : b - s] = 1
        codes, counts = np.ascontiguousarray(codes.T), counts.T
        logits = _forward(net, 0, codes) @ net.out[:HIDDEN]
        logits += _forward(net, 1, codes) @ net.out[HIDDEN:]
        logits += net.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (counts / logits.sum(axis=2))[:, :, None]
        np.add.at(total, [c[0] for c in part], logits.sum(axis=0))
    lengths = np.array([max(1, len(t)) for t in texts])
    return total / lengths[:, None]


def gradients(p: dict[str, np.ndarray], codes: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the bytes of ``codes`` [T, B] (256 is padding), and its gradients through time."""
    length, batch = codes.shape
    kind = p["table"].dtype
    mask = (codes != 256).astype(kind)
    states, kept = [], []
    for d in (0, 1):
        h = np.zeros((batch, HIDDEN), dtype=kind)
        hs = np.empty((length, batch, HIDDEN), dtype=kind)
        memo = [None] * length
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            x = p["table"][d][codes[t]]
            g = _sigmoid(x[:, : 2 * HIDDEN] + h @ p["recur"][d][:, : 2 * HIDDEN])
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ p["recur"][d][:, 2 * HIDDEN :])
            memo[t] = (h, z, r, c)
            h = z * h + (1 - z) * c
            hs[t] = h
        states.append(hs)
        kept.append(memo)
    both = np.concatenate(states, axis=2)
    logits = both @ p["out"] + p["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=2, keepdims=True)
    share = mask / mask.sum()
    loss = -float((np.log(np.maximum(prob[:, np.arange(batch), label], 1e-30)) * share).sum())
    delta = prob
    delta[:, np.arange(batch), label] -= 1
    delta *= share[:, :, None]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["out"] = np.einsum("tbh,tbn->hn", both, delta)
    grad["bias"] = delta.sum(axis=(0, 1))
    up = delta @ p["out"].T
    for d in (0, 1):
        recur = p["recur"][d]
        carry = np.zeros((batch, HIDDEN), dtype=kind)
        inputs = np.empty((length, batch, 3 * HIDDEN), dtype=kind)
        for t in range(length - 1, -1, -1) if d == 0 else range(length):
            h, z, r, c = kept[d][t]
            dh = up[t, :, d * HIDDEN : (d + 1) * HIDDEN] + carry
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            drh = dc @ recur[:, 2 * HIDDEN :].T
            dr = drh * h * r * (1 - r)
            dg = np.concatenate([dz, dr], axis=1)
            carry = dh * z + drh * r + dg @ recur[:, : 2 * HIDDEN].T
            grad["recur"][d][:, : 2 * HIDDEN] += h.T @ dg
            grad["recur"][d][:, 2 * HIDDEN :] += (r * h).T @ dc
            inputs[t, :, : 2 * HIDDEN] = dg
            inputs[t, :, 2 * HIDDEN :] = dc
        np.add.at(grad["table"][d], codes.ravel(), inputs.reshape(-1, 3 * HIDDEN))
    return loss, grad


def fit(texts: list[str], langs: list[str], steps: int = 400, batch: int = 192, length: int = 64, seed: int = 7) -> Network | None:
    """Train by backpropagation through time with Adam; every position of a window has the text's label."""
    languages = sorted(set(langs))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    raws = [t.encode("utf-8", "replace") for t in texts]
    by = [[r for r, g in zip(raws, langs, strict=True) if g == name and r] or [b" "] for name in languages]
    n, h3 = len(languages), 3 * HIDDEN
    p = {
        "table": rng.normal(0, 0.3, (2, 257, h3)), "recur": rng.normal(0, 0.3, (2, HIDDEN, h3)),
        "out": rng.normal(0, 0.3, (2 * HIDDEN, n)), "bias": np.zeros(n),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        label = rng.integers(0, n, batch)
        codes = np.full((length, batch), 256, dtype=np.int64)
        for j, g in enumerate(label):
            raw = by[g][rng.integers(0, len(by[g]))]
            at = rng.integers(0, max(1, len(raw) - length + 1))
            got = np.frombuffer(raw, dtype=np.uint8)[at : at + length]
            codes[: len(got), j] = got
        _, grad = gradients(p, codes, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.03 * min(1.0, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / steps))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Network(languages, p["table"], p["recur"], p["out"], p["bias"])


def train(documents: DataFrame, modulus: int = 4, remainder: int = 2) -> Network | None:
    """Fit on a bounded sample of the rows outside the held-out fold."""
    usable = documents.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"), modulus, remainder)).where(F.col("text").rlike(r"\p{L}"))
    # Only ids are ranked, first within shares of a language, so that a language of most rows is many tasks.
    order = F.xxhash64(F.col("doc_id").cast("string"))
    keys = usable.select("lang", "doc_id").withColumns({"h": order, "share": F.pmod(order, F.lit(SHARES))})
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
    keys = keys.distinct().withColumn("rank", best("lang", "share")).where(F.col("rank") <= MAX_PER_LANGUAGE)
    keys = materialize(keys.withColumn("rank", best("lang")).where(F.col("rank") <= MAX_PER_LANGUAGE).select("lang", "doc_id"), "teaching-ids")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    # The stretches spread evenly over the text; each starts somewhere in its own part, told by a hash.
    part = F.greatest((F.length("text") - CUT) / CUTS, F.lit(0.0))
    start = lambda k: (part * (k + F.pmod(F.xxhash64("text", k), F.lit(1000)) / 1000)).cast("int") + 1
    cuts = F.transform(F.sequence(F.lit(0), F.lit(CUTS - 1)), lambda k: F.substring(F.col("text"), start(k), F.lit(CUT)))
    chosen = usable.join(keys, ["lang", "doc_id"]).select("lang", "doc_id", F.xxhash64("text").alias("h"), cuts.alias("cuts"))
    rows = chosen.groupBy("lang", "doc_id").agg(F.min_by("cuts", "h").alias("cuts")).orderBy("lang", "doc_id").collect()
    taught = [(x, r.lang) for r in rows for x in dict.fromkeys(r.cuts)]
    return fit([x for x, _ in taught], [g for _, g in taught])


_NETWORK: dict[int, Network | None] = {}


def predict(documents: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, predicted language and its mean probability over all positions."""
    ship(documents.sparkSession)
    raw = pickle.dumps(net)
    sent = documents.sparkSession.sparkContext.broadcast(raw)
    key = zlib.crc32(raw)
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _NETWORK:
            _NETWORK.clear()
            _NETWORK[key] = pickle.loads(sent.value)
        model = _NETWORK[key]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [bool(t) and model is not None and LETTER.search(t) is not None for t in texts]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at, part, size = [], [], 0

            def flush() -> None:
                for k, row in zip(at, probabilities(model, part), strict=True):
                    best = int(np.argmax(row))
                    langs[k], scores[k] = model.languages[best], min(1.0, float(row[best]))

            for k, t in enumerate(texts):
                if known[k]:
                    at.append(k)
                    part.append(t.encode("utf-8", "replace"))
                    size += len(part[-1])
                    if size > 4_000_000:
                        flush()
                        at, part, size = [], [], 0
            if part:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")
