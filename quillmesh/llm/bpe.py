"""Byte-level BPE encoding and decoding by a pair occurrence index.

Distinct chunks (a run of non-space characters with its leading space) of a batch are laid out
as one array of symbols with links to the neighbours.  An index maps the rank of every pair to
the positions where the pair occurs; ranks are applied in ascending order, each to all of its
positions at once, and only the lists of the pairs that a merge creates are updated.  A merge's
result always takes part in later ranks only, so one ascending sweep equals merging every word
on its own.

Nulls and edges: null text is the empty text (no tokens); rows are independent, so repeated and
null ids, ties and clashing column names need no care; an empty table gives an empty result.
Text that spells an added token becomes that token, as the tokenizer file asks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import ship

#: The byte-level split pattern and the Unicode white space that it means by \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
#: Cuts at white space exactly where SPLIT does; a chunk's pieces don't depend on what is around it.
CHUNK = " ?[^" + SPACE + "]+|[" + SPACE + "]+(?![^" + SPACE + "])|[" + SPACE + "]+"

#: Distinct chunks that one worker keeps before it starts afresh (about 50 MB), and the characters
#: of one batch, whose new chunks come on top.
CACHE_CHUNKS = 160_000
BATCH_CHARS = 4_000_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [out[b] if b in out else chr(next(spare)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder over one tokenizer file (its JSON text)."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        letters = byte_letters()
        to_byte = {c: i for i, c in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = np.array([vocab[c] for c in letters], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.split = regex.compile(SPLIT)
        self.chunk = re.compile(CHUNK)
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.counts = array("i")
        self.spelled: list[str] = []
        self.decoded: list[bytes] = []
        for token, i in self.added.items():  # under a key that no chunk can be
            self.index[" \0" + token] = len(self.spelled)
            self.counts.append(1)
            self.spelled.append(str(i))
            self.decoded.append(self.bytes_of[i])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it never merges."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(ends) else 0
        if not n:
            return [[] for _ in pieces]
        sym = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        nxt = np.arange(1, n + 1)
        nxt[ends[lengths > 0] - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[(ends - lengths)[lengths > 0]] = -1
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(positions: np.ndarray) -> None:
            rank = self.ranks(sym[positions], sym[nxt[positions]])
            known = rank >= 0
            positions, rank = positions[known], rank[known]
            if not len(rank):
                return
            by = np.argsort(rank, kind="stable")
            positions, rank = positions[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist(), len(rank)]
            heads = rank[starts[:-1]].tolist()
            for k, r in enumerate(heads):
                got = positions[starts[k] : starts[k + 1]]
                if r in lists:
                    lists[r].append(got)
                else:
                    lists[r] = [got]
                    heapq.heappush(heap, r)

        add(np.flatnonzero(nxt >= 0))
        while heap:
            r = heapq.heappop(heap)
            got = lists.pop(r)
            p = np.unique(np.concatenate(got)) if len(got) > 1 else got[0]
            a, b = self.left[r], self.right[r]
            q = nxt[p]
            good = (sym[p] == a) & (q >= 0) & (sym[q] == b)
            p, q = p[good], q[good]
            if not len(p):
                continue
            if a == b and len(p) > 1:  # of overlapping pairs every other one merges, from the left
                p = np.sort(p)
                q = nxt[p]
                new_run = np.empty(len(p), dtype=bool)
                new_run[0] = True
                new_run[1:] = q[:-1] != p[1:]
                at = np.arange(len(p))
                first = np.maximum.accumulate(np.where(new_run, at, 0))
                even = (at - first) % 2 == 0
                p, q = p[even], q[even]
            sym[p] = self.made[r]
            sym[q] = -1
            after = nxt[q]
            nxt[p] = after
            has = after >= 0
            prv[after[has]] = p[has]
            before = prv[p]
            add(np.unique(np.concatenate([before[before >= 0], p[has]])))
        alive = sym >= 0
        ids = sym[alive].tolist()
        kept = np.concatenate([[0], np.cumsum(alive)])
        bounds = kept[np.concatenate([[0], ends])].tolist()
        return [ids[bounds[k] : bounds[k + 1]] for k in range(len(pieces))]

    def learn(self, chunks: list[str]) -> None:
        """Encode and decode new distinct chunks; they get the next places of the cache."""
        pieces: list[bytes] = []
        sizes = []
        for c in chunks:
            found = self.split.findall(c)
            sizes.append(len(found))
            pieces += [x.encode("utf-8", "surrogatepass") for x in found]
        ids = self.merge(pieces)
        at = 0
        for k in sizes:
            own = ids[at] if k == 1 else [i for x in ids[at : at + k] for i in x]
            at += k
            self.counts.append(len(own))
            self.spelled.append(",".join(map(str, own)))
            self.decoded.append(b"".join([self.bytes_of[i] for i in own]))

    def places(self, texts: list[str | None]) -> list[array]:
        """For each text the cache places of its chunks, all of them learned."""
        if len(self.spelled) > CACHE_CHUNKS:
            self.forget()
        fresh: list[str] = []
        base = len(self.spelled)

        class Seen(dict):
            def __missing__(self, key: str) -> int:
                fresh.append(key)
                self[key] = at = base + len(fresh) - 1
                return at

        seen = Seen(self.index)
        out = []
        for text in texts:
            own = array("i")
            for part in self.special.split(text or "") if self.special else [text or ""]:
                if part in self.added:
                    own.append(self.index[" \0" + part])
                elif part:
                    own.extend(map(seen.__getitem__, self.chunk.findall(part)))
            out.append(own)
        self.index = dict(seen)
        self.learn(fresh)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of one text."""
        (own,) = self.places([text])
        spelled = ",".join([x for x in (self.spelled[i] for i in own) if x])
        return [int(x) for x in spelled.split(",")] if spelled else []

    def decode(self, ids: list[int]) -> str:
        """Text of token ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


_LOADED: dict[str, PairIndexBPE] = {}


def _loaded(spec: str) -> PairIndexBPE:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PairIndexBPE(spec)
    return _LOADED[key]


def _groups(sizes: list[int | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text, so that memory follows the limit and the longest text."""
    start = held = 0
    for i, n in enumerate(sizes):
        held += n or 0
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def bpe_encode_decode(df: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Per row: id, token count, SHA-256 of the comma-joined ids and of the decoded text.

    ``spec`` is the tokenizer file's JSON text (its size doesn't grow with the data; it goes out
    as a broadcast).  ``with_ids`` adds the ids, ``with_text`` the decoded text.
    """
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(spec)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    arrow = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    arrow |= {"ids": pa.list_(pa.int32())} if with_ids else {}
    arrow |= {"decoded": pa.string()} if with_text else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(sent.value)
        for batch in batches:
            column = batch.column(1)
            for lo, hi in _groups(pc.binary_length(column).to_pylist(), BATCH_CHARS):
                places = model.places(column.slice(lo, hi - lo).to_pylist())
                counts = np.array(model.counts, dtype=np.int32)
                spelled, decoded = model.spelled, model.decoded
                rows: dict[str, list] = {k: [] for k in arrow}
                for own in places:
                    text_ids = ",".join([spelled[i] for i in own])
                    text = b"".join([decoded[i] for i in own]).decode("utf-8", "replace")
                    rows["n_tokens"].append(int(counts[np.frombuffer(own, dtype=np.int32)].sum()) if own else 0)
                    rows["ids_sha256"].append(hashlib.sha256(text_ids.encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        rows["ids"].append([int(x) for x in text_ids.split(",")] if text_ids else [])
                    if with_text:
                        rows["decoded"].append(text)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(rows[k], t) for k, t in arrow.items()]], [id_col, *arrow])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
