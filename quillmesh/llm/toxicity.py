"""Toxicity by compression distance between two zstandard dictionaries.

An ordinary dictionary is trained on the frequent words of ordinary text; the toxic one holds,
before that same content, the words that toxic text uses out of proportion.  A window is one
word, repeated so that the frame's fixed cost cancels out; its margin is the compressed length
under the ordinary dictionary minus that under the toxic one.  Margins are calibrated by word
length on labelled rows that the dictionaries have not seen, and a document's score is a
logistic function of its strongest windows.

Learning uses a bounded sample of labelled ids (``MAX_TOXIC`` and ``MAX_ORDINARY`` of them in the
order of a hash), each with its whole text; of several texts of one id the one of the least hash
teaches.  A teaching text reaches the driver as its distinct words.  Scoring covers every window of
every document.

Nulls and edges: null, empty and blank texts have no window and get the score of a document
with none; rows without a label or text never teach; with no toxic or no ordinary teaching rows
every score is 0; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import held_out, ship

MAX_TOXIC = 2_000
MAX_ORDINARY = 4_000
#: Sizes of the dictionaries' contents, as zstandard's trainer takes one: whole words, the best first, up to here.
ORDINARY_BYTES = 131_072
TOXIC_BYTES = 65_536
#: Times that a word is written in its window.
REPEATS = 8
#: Lengths and margins from these on share a cell of the calibration.
LONGEST, WIDEST = 24, 8
EDGE = b".,;:!?\"'()[]{}#*$%&|<>-_=+/\\`~"
THRESHOLD = 0.7
#: Share of clean documents that the calibrated cut may take.
MAX_FALSE = 0.01
CACHE_WORDS = 200_000

PARAMETERS = {
    "window_log": 18, "chain_log": 18, "hash_log": 17, "search_log": 8, "min_match": 4, "target_length": 16, "strategy": 5,
    "write_content_size": False, "write_checksum": False, "write_dict_id": False,
}


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    cells: np.ndarray  # log likelihood ratio of a window by length and margin
    weights: np.ndarray
    bias: float


def windows(text: str | None) -> set[bytes]:
    """Distinct words of a text, lower case, without punctuation at the ends."""
    found = {w.strip(EDGE) for w in (text or "").lower().encode("utf-8", "replace").split()}
    found.discard(b"")
    return found


class Compressors:
    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.calls = [self._compressor(x) for x in (ordinary, toxic)]

    @staticmethod
    def _compressor(raw: bytes):
        parameters = zstandard.ZstdCompressionParameters(**PARAMETERS)
        content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(compression_params=parameters, dict_data=content).compress

    def margin(self, word: bytes) -> int:
        window = (b" " + word) * REPEATS + b" "
        return len(self.calls[0](window)) - len(self.calls[1](window))


def _cell(word: bytes, margin: int) -> tuple[int, int]:
    return min(len(word), LONGEST), min(max(margin, 0), WIDEST)


def _features(values: list[float], n: int) -> list[float]:
    top = sorted(values, reverse=True)[:3]
    top += [0.0] * (3 - len(top))
    return [*top, math.log1p(n)]


def _content(words: list[bytes], size: int) -> bytes:
    """The words from the best on, as many as fit, the best of them last."""
    n = 0
    for k, w in enumerate(words):
        n += len(w) + 1
        if n >= size:
            words = words[:k]
            break
    return b" ".join([b"", *words[::-1], b""])


def fit(toxic_bags: list[bytes], ordinary_bags: list[bytes]) -> Model | None:
    """Train both dictionaries on two thirds of the texts (their sorted distinct words, one space between) and calibrate on the rest."""
    if not toxic_bags or not ordinary_bags:
        return None
    # Words are numbered, so that a text is a small array and not a set of strings.
    number: dict[bytes, int] = {}
    bags = [[np.array([number.setdefault(w, len(number)) for w in bag.split()], dtype=np.int32) for bag in some] for some in (toxic_bags, ordinary_bags)]
    part = [[zlib.crc32(bag) % 3 == 2 for bag in some] for some in (toxic_bags, ordinary_bags)]
    learn = [[b for b, c in zip(bags[k], part[k], strict=True) if not c] or bags[k] for k in (0, 1)]
    check = [[b for b, c in zip(bags[k], part[k], strict=True) if c] or bags[k] for k in (0, 1)]
    count = [np.bincount(np.concatenate([np.empty(0, dtype=np.int32), *learn[k]]), minlength=len(number)) for k in (0, 1)]
    n_toxic, n_ordinary = len(learn[0]), len(learn[1])
    words = list(number)
    chosen = []
    for i in np.flatnonzero(count[0] >= max(3, 0.004 * n_toxic)).tolist():
        lift = (count[0][i] / n_toxic) / ((count[1][i] + 0.5) / n_ordinary)
        if lift > 8 and count[0][i] * math.log(lift) > 12:
            chosen.append((count[0][i] * math.log(lift), words[i]))
    marked = _content([w for _, w in sorted(chosen, reverse=True)], TOXIC_BYTES)
    usual = _content([w for _, w in sorted(((int(count[1][i]), words[i]) for i in np.flatnonzero(count[1] > 1).tolist()), reverse=True)], ORDINARY_BYTES)
    ordinary, toxic = usual or b" ", marked + usual or b" "
    margin = Compressors(ordinary, toxic).margin
    known = np.full(len(words), -1, dtype=np.int32)  # a cell's number, once it is known

    def cells_of(bag: np.ndarray) -> list[tuple[int, int]]:
        for i in bag[known[bag] < 0].tolist():
            length, m = _cell(words[i], margin(words[i]))
            known[i] = length * (WIDEST + 1) + m
        return [divmod(c, WIDEST + 1) for c in known[bag].tolist()]

    seen = [[cells_of(b) for b in check[k]] for k in (0, 1)]
    # Per cell: how much more often a toxic document holds such a window.
    hits = [np.zeros((LONGEST + 1, WIDEST + 1)) for _ in (0, 1)]
    for k in (0, 1):
        for doc in seen[k]:
            for length, m in set(doc):
                hits[k][length, m] += 1
    # Wider margins of the same length and neighbouring lengths lend their counts.
    rate = []
    for k in (0, 1):
        pooled = hits[k].copy()
        pooled[1:] += 0.5 * hits[k][:-1]
        pooled[:-1] += 0.5 * hits[k][1:]
        rate.append((pooled + 0.5) / (len(check[k]) + 1))
    cells = np.log(rate[0] / rate[1])
    cells[:, 0] = 0
    cells = np.maximum.accumulate(np.maximum(cells, 0), axis=1)
    x = np.array([_features([cells[c] for c in doc], len(doc)) for k in (0, 1) for doc in seen[k]])
    y = np.array([1.0] * len(check[0]) + [0.0] * len(check[1]))
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    ridge = np.diag([0.3] * x.shape[1] + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    # The cut with the best F1 that hardly ever takes a clean document becomes the score THRESHOLD.
    z = design @ beta
    order = np.argsort(-z, kind="stable")
    caught = np.cumsum(y[order])
    taken = np.arange(1, len(z) + 1)
    last = np.append(z[order][1:] != z[order][:-1], True)
    usable = last & (taken - caught <= MAX_FALSE * len(check[1])) & (caught > 0)
    if usable.any():
        best = int(np.argmax(np.where(usable, 2 * caught / (taken + y.sum()), -1)))
        cut = z[order][best]
        below = z[order][best + 1] if best + 1 < len(z) else cut - 1
    else:  # the sample teaches nothing that tells the classes apart
        cut = below = z.max() + 1
    shift = math.log(THRESHOLD / (1 - THRESHOLD)) - (cut + below) / 2
    return Model(ordinary, toxic, cells, beta[:-1], float(beta[-1] + shift))


class Scorer:
    def __init__(self, model: Model | None) -> None:
        self.model = model
        self.known: dict[bytes, float] = {}
        if model:
            self.margin = Compressors(model.ordinary, model.toxic).margin

    def score(self, text: str | None) -> float:
        if self.model is None:
            return 0.0
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, cells, values = self.known, self.model.cells, []
        bag = windows(text)
        for w in bag:
            v = known.get(w)
            if v is None:
                v = known[w] = float(cells[_cell(w, self.margin(w))])
            if v > 0:
                values.append(v)
        z = float(np.dot(self.model.weights, _features(values, len(bag)))) + self.model.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(documents: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> Model | None:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    usable = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = usable.where(~held_out(F.col("doc_id"), modulus, remainder))
    by_hash = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    ids = usable.where("toxic = 1").orderBy(*by_hash).limit(MAX_TOXIC).unionAll(usable.where("toxic = 0").orderBy(*by_hash).limit(MAX_ORDINARY))
    ship(documents.sparkSession)
    texts = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")  # at most MAX_TOXIC + MAX_ORDINARY ids

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [b" ".join(sorted(windows(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(held, pa.binary())], ["id", "toxic", "h", "words"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = texts.select(F.col("doc_id").alias("id"), "toxic", "text", F.xxhash64("text").alias("h")).mapInArrow(bags, f"id {id_type}, toxic int, h long, words binary")
    rows = rows.groupBy("id", "toxic").agg(F.min_by("words", "h").alias("words")).orderBy("id").select("toxic", "words").toArrow()
    toxic = rows.column("toxic").to_numpy()
    return fit(*[rows.column("words").filter(pa.array(toxic == k)).to_pylist() for k in (1, 0)])


_SCORER: dict[int, Scorer] = {}


def classify(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``documents`` but the text, with ``score`` (0 to 1) and ``predicted``."""
    return _scored(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _scored(df: DataFrame, model: Model | None, keep_text: bool = False) -> DataFrame:
    """``df`` with its score; the column ``text`` goes unless ``keep_text``."""
    spark = df.sparkSession
    ship(spark)
    raw = pickle.dumps(model)
    sent = spark.sparkContext.broadcast(raw)
    key = zlib.crc32(raw)
    columns = [c for c in df.columns if c != "text" or keep_text]
    places = [df.columns.index(c) for c in columns]
    at = df.columns.index("text")
    names = [f"c{k}" for k in range(len(columns))]
    types = ", ".join(f"{n} {df.schema[p].dataType.simpleString()}" for n, p in zip(names, places, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORER:
            _SCORER.clear()
            _SCORER[key] = Scorer(pickle.loads(sent.value))
        score = _SCORER[key].score
        for batch in batches:
            values = [score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*[batch.column(p) for p in places], pa.array(values, pa.float64())], [*names, "score"])

    return df.mapInArrow(run, f"{types}, score double").toDF(*columns, "score")


def keep_clean(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``documents`` whose text is not predicted toxic, columns unchanged."""
    names = documents.columns
    numbered = documents.toDF(*["text" if c == "text" else f"k{k}" for k, c in enumerate(names)])
    scored = _scored(numbered, model, keep_text=True)
    return scored.where(F.col("score") < THRESHOLD).drop("score").toDF(*names)
