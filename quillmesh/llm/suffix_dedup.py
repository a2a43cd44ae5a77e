"""Substring dedup over prefix-partitioned suffix trees.

A suffix is a position of a text where ``WINDOW`` words follow.  Three steps build the trees of the
suffixes that may repeat:

1. Candidates.  A repeated window repeats its least eight-word phrase; suffixes of windows whose
   least phrase stands once in the corpus are leaves right below the root and go first.
2. Prefixes.  Suffixes are dealt into groups by their first words.  A prefix has ``PREFIXES[0]``
   words, and more as long as its suffixes are over ``GROUP``; a prefix that has grown to the whole
   window is itself a node with very many suffixes, which are all repeats and need no list.
   Prefixes below the limit are bundled into parts of about ``PART`` suffixes: those of
   ``PREFIXES[0]`` words by their least word pair, so that suffixes that follow each other often
   share a part and travel as one run of words; longer ones, and those of a pair of too many
   suffixes, each by itself.
3. Trees.  Suffixes are sorted by their words; the longest common prefix of neighbours in that
   order gives the tree's internal nodes.  Runs of neighbours that share ``WINDOW`` words or more
   are the leaves below its deep internal nodes; their positions, merged, are the repeated spans.
   Every task does so first with the suffixes that it deals out, and of the leaves below one deep
   node only the first travels on to its part, where the trees of all tasks meet.

A word travels as one byte of its hash; suffixes whose bytes agree are told apart by a 64-bit
fingerprint of the whole window.  Texts are one node of the input whatever the number of their
copies: a text with copies repeats as a whole, and copies add nothing to the groups.

Texts are shuffled only where they meet phrases or spans of theirs: a bitmap of the hashes of the
texts that have some, of ``MOST_BITS`` at most, lets the others pass by.  A bit that is set for
another text's sake costs a shuffled row and changes no result.

Nulls and edges: null text has no words; a text of fewer than ``WINDOW`` words keeps all;
overlapping repeats inside one text count, as each starts elsewhere; null and repeated ids are
rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import drop_materialized, materialize, ship
from quillmesh.llm.grams import grams, mix, word_hashes

WINDOW = 35
PHRASE = 8
#: Lengths of the variable prefixes; the last is the whole window.
PREFIXES = (8, 16, 24, WINDOW)
#: Suffixes of one group; more only where the corpus has over GROUP * MOST_FULL candidates.
GROUP = 2_000
#: Full prefixes of one length that go out as a broadcast (8 bytes each); with the limit raised
#: to candidates / MOST_FULL there can't be more.
MOST_FULL = 500_000
#: Suffixes of one part, which a task holds at a time (about 60 bytes each).
PART = 200_000
#: Words of a pair, and the suffixes of one pair as a share of PART beyond which it bundles none.
PAIR, PAIR_SHARE = 2, 8
#: Bits of the map of texts with phrases or spans: 16 a text, and no more than these (8 MB).
MOST_BITS = 1 << 26
#: Bits of one page of the map, as ``bitmap_construct_agg`` makes them.
PAGE_BITS = 1 << 15


def _anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window the position of its least phrase, and the hashes of all phrases."""
    phrases = grams(words, PHRASE)
    span = WINDOW - PHRASE + 1
    if len(words) < WINDOW:
        return np.empty(0, dtype=np.int64), phrases
    return sliding_window_view(phrases, span).argmin(axis=1) + np.arange(len(phrases) - span + 1), phrases


def _hashes(text: str | None) -> np.ndarray:
    return word_hashes(text.encode("utf-8", "surrogatepass"))[2] if text else np.empty(0, dtype=np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its distinct least phrases, each with the number of places where it is one."""
    for batch in batches:
        keys, phrases, runs = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, all_phrases = _anchors(_hashes(text))
            own, times = np.unique(all_phrases[np.unique(at)], return_counts=True)
            keys.append(np.full(len(own), key, dtype=np.int64))
            phrases.append(_signed(own))
            runs.append(times.astype(np.int32))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, phrases, runs)], ["t", "phrase", "runs"])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (t, text, found) to (t, text, places, n): the places of suffixes below one of the phrases ``found``, as bits, and their number."""
    for batch in batches:
        places, n = [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            at, phrases = _anchors(_hashes(text))
            below = np.isin(_signed(phrases)[at], found.values.to_numpy())
            places.append(np.packbits(below).tobytes())
            n.append(int(below.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary()), pa.array(n, pa.int64())], ["t", "text", "places", "n"])


def _places(raw: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8)))


def _pairs(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The least word pair of the first PREFIXES[0] words from each place."""
    return _signed(sliding_window_view(grams(words, PAIR), PREFIXES[0] - PAIR + 1)[place].min(axis=1))


class Full:
    """The prefixes over the limit, by length, sorted."""

    def __init__(self, by_length: dict[int, np.ndarray]) -> None:
        self.by_length = by_length

    def split(self, words: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key and length of the group of each suffix, and whether its whole window is a full prefix."""
        key = np.zeros(len(place), dtype=np.int64)
        length = np.zeros(len(place), dtype=np.int64)
        open_ = np.ones(len(place), dtype=bool)
        for n in PREFIXES:
            if not open_.any():
                break
            own = _signed(grams(words, n))[place]
            key[open_], length[open_] = own[open_], n
            full = self.by_length.get(n)
            open_ &= np.isin(own, full) if full is not None and len(full) else False
        return key, length, open_


def _counted(lengths: tuple[int, ...], sent) -> object:
    """Batches of (t, text, places) to (length, prefix, n), summed per batch; ``sent`` has the full prefixes of shorter lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list[np.ndarray]] = {n: [] for n in lengths}
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, place = _hashes(text), _places(places)
                if sent is not None:
                    place = place[np.isin(_signed(grams(words, PREFIXES[0]))[place], sent.value)]
                for n in lengths if len(place) else ():
                    held[n].append(_pairs(words, place) if n == PAIR else _signed(grams(words, n))[place])
            for n, parts in held.items():
                if parts:
                    prefix, times = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prefix), n, dtype=np.int32)), pa.array(prefix), pa.array(times.astype(np.int64))], ["length", "prefix", "n"])

    return run


def _deal(parts: int, sent) -> object:
    """Batches of (t, text, places) to blobs of suffixes per part, and to spans that repeat for sure (negative parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = Full(sent.value)
        wide = sent.value.get(PAIR, np.empty(0, dtype=np.int64))
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for key, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, place = _hashes(text), _places(places)
                prefix, length, sure = full.split(words, place)
                if sure.any():
                    again = place[sure]
                    yield _for_sure(_merged(np.full(len(again), key, dtype=np.int64), again), parts)
                    prefix, length, place = prefix[~sure], length[~sure], place[~sure]
                if not len(place):
                    continue
                letters = np.append((words & np.uint64(255)).astype(np.uint8), np.zeros(WINDOW, dtype=np.uint8))
                path = sliding_window_view(letters, WINDOW)[place]
                prints = _signed(grams(words, WINDOW))[place]
                pair = _pairs(words, place)
                alone = (length > PREFIXES[0]) | np.isin(pair, wide)
                held.append((prefix, length.astype(np.uint8), np.full(len(place), key, dtype=np.int64), place.astype(np.int32), prints, path, pair, alone))
                n += len(place)
                if n >= PART:
                    yield from _own_tree(held, parts)
                    held, n = [], 0
        if held:
            yield from _own_tree(held, parts)

    return run


def _own_tree(held: list[tuple[np.ndarray, ...]], parts: int) -> Iterator[pa.RecordBatch]:
    """Spans below the deep nodes of the suffixes held, and blobs with one suffix for each of these nodes and all others."""
    *columns, letters, pair, alone = (np.concatenate(x) for x in zip(*held, strict=True))
    columns.append(letters[:, PREFIXES[0] :])
    rows = _suffixes([tuple(columns)])
    order, common = suffix_order(rows)
    deep = common >= WINDOW
    leaf = order[deep | np.append(deep[1:], False)]
    if len(leaf):
        yield _for_sure(_merged(rows["t"][leaf], rows["place"][leaf]), parts)
    left = np.sort(order[~deep])
    if (one := left[alone[left]]).size:
        yield _blobs([tuple(x[one] for x in columns)], parts)
    if (many := left[~alone[left]]).size:
        yield _runs(rows[many], letters[many], pair[many], parts)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((np.ascontiguousarray(key).view(np.uint64) >> np.uint64(16)) % np.uint64(parts)).astype(np.int32)


def _runs(rows: np.ndarray, letters: np.ndarray, pair: np.ndarray, parts: int) -> pa.RecordBatch:
    """Blobs of runs per part; suffixes that follow each other in a text and share the part are a run."""
    part = _part(mix(pair.view(np.uint64)), parts)
    begins = np.append(True, (part[1:] != part[:-1]) | (rows["t"][1:] != rows["t"][:-1]) | (rows["place"][1:] != rows["place"][:-1] + 1))
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    blobs = [pack_runs(rows[x], letters[x], begins[x]) for x in np.split(order, first[1:])]
    none = np.zeros(len(own), dtype=np.int32)
    return _dealt(own, none.astype(np.int64), none + 1, none, blobs)


def pack_runs(rows: np.ndarray, letters: np.ndarray, begins: np.ndarray) -> bytes:
    """Runs of suffixes: a suffix that continues one adds its last letter (a byte of its last word's hash) and its fingerprint."""
    at = np.flatnonzero(begins)
    pieces = [np.array([len(at), len(rows)], dtype="<i4"), rows["t"][at], rows["place"][at], np.diff(np.append(at, len(rows))).astype("<i4"), rows["print"], letters[at], letters[~begins, -1]]
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in pieces)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_runs(blob: bytes) -> np.ndarray:
    """SUFFIX rows of :func:`pack_runs`; the prefix is its letters, with length 0."""
    raw = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)
    runs, n = np.frombuffer(raw, dtype="<i4", count=2).tolist()
    offset = 8

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal offset
        out = np.frombuffer(raw, dtype=kind, count=count, offset=offset)
        offset += out.nbytes
        return out

    t, place, times, prints = take("<i8", runs), take("<i4", runs), take("<i4", runs), take("<i8", n)
    head, tail = take("u1", runs * WINDOW).reshape(runs, WINDOW), take("u1", n - runs)
    in_run = np.arange(n) - np.repeat(np.cumsum(times) - times, times)
    starts = np.cumsum(times + WINDOW - 1) - (times + WINDOW - 1)
    stream = np.empty(n + runs * (WINDOW - 1), dtype=np.uint8)
    of_head = starts[:, None] + np.arange(WINDOW)
    rest = np.ones(len(stream), dtype=bool)
    rest[of_head] = False
    stream[of_head], stream[rest] = head, tail
    letters = sliding_window_view(stream, WINDOW)[np.repeat(starts, times) + in_run]
    prefix = np.ascontiguousarray(letters[:, : PREFIXES[0]]).view("<i8").ravel()
    return _suffixes([(prefix, np.zeros(n, dtype=np.uint8), np.repeat(t, times), np.repeat(place, times) + in_run, prints, letters[:, PREFIXES[0] :])])


def _for_sure(spans: np.ndarray, parts: int) -> pa.RecordBatch:
    part = -1 - (np.ascontiguousarray(spans["t"]).view(np.uint64) % np.uint64(parts)).astype(np.int32)
    return _dealt(part, *(np.ascontiguousarray(spans[x]) for x in SPAN.names), [b""] * len(spans))


def _dealt(part: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray, blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part), pa.array(t), pa.array(lo), pa.array(hi), pa.array(blob, pa.binary())], ["part", "t", "lo", "hi", "blob"])


#: One suffix in a blob: key and length of its prefix, text, place, fingerprint, and a byte for each word after PREFIXES[0].
SUFFIX = np.dtype([("prefix", "<i8"), ("length", "u1"), ("t", "<i8"), ("place", "<i4"), ("print", "<i8"), ("path", f"V{WINDOW - PREFIXES[0]}")])

#: A repeated span: text, first word, end.
SPAN = np.dtype([("t", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


def _suffixes(held: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    rows = np.empty(len(columns[0]), dtype=SUFFIX)
    for name, column in zip(SUFFIX.names, columns, strict=True):
        rows[name] = np.ascontiguousarray(column).view(SUFFIX[name]).ravel() if name == "path" else column
    return rows


def _blobs(held: list[tuple[np.ndarray, ...]], parts: int) -> pa.RecordBatch:
    rows = _suffixes(held)
    part = _part(rows["prefix"], parts)
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    blobs = [x.tobytes() for x in np.split(rows[order], first[1:])]
    none = np.zeros(len(own), dtype=np.int32)
    return _dealt(own, none.astype(np.int64), none, none, blobs)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans below the deep nodes of each part, and those for sure; the rows come sorted by part."""
    held: list[np.ndarray] = []
    of = None
    for batch in batches:
        parts, sure = batch.column(0), batch.filter(pc.less(batch.column(0), 0))
        if len(sure):
            spans = np.empty(len(sure), dtype=SPAN)
            for k, name in enumerate(SPAN.names, 1):
                spans[name] = sure.column(k).to_numpy()
            yield _told(spans)
        for part, in_runs, blob in zip(parts.to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
            if part < 0:
                continue
            if part != of and held:
                yield _spans(np.concatenate(held))
                held = []
            of = part
            held.append(unpack_runs(blob.as_py()) if in_runs else np.frombuffer(blob.as_py(), dtype=SUFFIX))
    if held:
        yield _spans(np.concatenate(held))


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of suffixes (SUFFIX rows), and the longest common prefix of each with the one before it.

    The common prefix is counted in words; suffixes of different groups share none that matters.
    """
    width = WINDOW - PREFIXES[0]
    path = np.zeros((len(rows), -(-width // 8) * 8), dtype=np.uint8)
    path[:, :width] = np.ascontiguousarray(rows["path"]).view(np.uint8).reshape(len(rows), width)
    words = path.view(">u8")
    order = np.lexsort((rows["print"], *words.T[::-1], rows["prefix"], rows["length"]))
    path, prefix, prints = path[order, :width], rows["prefix"][order], rows["print"][order]
    same = (prefix[1:] == prefix[:-1]) & (rows["length"][order][1:] == rows["length"][order][:-1])
    differ = path[1:] != path[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) + PREFIXES[0]
    # All bytes agree but the windows don't: two words share a byte somewhere.
    common = np.where((common == WINDOW) & (prints[1:] != prints[:-1]), WINDOW - 1, common)
    return order, np.concatenate([[0], np.where(same, common, 0)]) if len(rows) else np.empty(0, dtype=np.int64)


def _merged(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The words that windows at these places cover, as SPAN rows; places in a row are one span."""
    by = np.lexsort((place, text))
    text, place = text[by], place[by]
    begins = np.append(True, (text[1:] != text[:-1]) | (place[1:] > place[:-1] + 1)) if len(text) else np.empty(0, dtype=bool)
    spans = np.empty(int(begins.sum()), dtype=SPAN)
    spans["t"], spans["lo"] = text[begins], place[begins]
    spans["hi"] = place[np.append(begins[1:], True)] + WINDOW if len(text) else 0
    return spans


def _told(spans: np.ndarray) -> pa.RecordBatch:
    """(t, span) with the pair (lo, hi) as one number."""
    pairs = (spans["lo"].astype(np.int64) << 32) | spans["hi"]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(spans["t"])), pa.array(pairs)], ["t", "span"])


def _spans(rows: np.ndarray) -> pa.RecordBatch:
    """Spans of positions under the internal nodes of depth WINDOW or more."""
    order, common = suffix_order(rows)
    deep = common >= WINDOW
    leaf = order[deep | np.append(deep[1:], False)]
    return _told(_merged(rows["t"][leaf], rows["place"][leaf]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words_n, gone_n, digests, texts = [], [], [], []
        for text, rows, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            removed = np.zeros(len(words) + 1, dtype=np.int32)
            if rows > 1 and len(words) >= WINDOW:
                removed[0] = 1
            elif spans.is_valid:
                pairs = spans.values.to_numpy()
                np.add.at(removed, pairs >> 32, 1)
                np.add.at(removed, pairs & 0xFFFFFFFF, -1)
            if removed.any():
                keep = np.cumsum(removed[:-1]) <= 0
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            else:
                kept = words
            left = b" ".join(kept)
            words_n.append(len(words))
            gone_n.append(len(words) - len(kept))
            digests.append(hashlib.sha256(left).hexdigest())
            texts.append(left.decode("utf-8", "surrogatepass"))
        columns = [batch.column(0), pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept_sha256", "kept"])


def _cut_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        yield batch.select(["id", "n_words", "n_removed", "kept_sha256"])


def full_prefixes(texts: DataFrame) -> tuple[int, dict[int, np.ndarray]]:
    """Number of candidate suffixes of (t, text, places, n), and the prefixes of each length over the group limit.

    Under ``PAIR`` are the word pairs of too many suffixes.
    """
    spark = texts.sparkSession
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(GROUP, -(-total // MOST_FULL))

    def over(lengths: tuple[int, ...], sent) -> dict[int, np.ndarray]:
        counts = texts.select("t", "text", "places").mapInArrow(_counted(lengths, sent), "length int, prefix long, n long").groupBy("length", "prefix").agg(F.sum("n").alias("n"))
        # At most total / limit <= MOST_FULL of each length.
        most = F.when(F.col("length") == PAIR, max(limit, PART // PAIR_SHARE)).otherwise(limit)
        table = counts.where(F.col("n") > most).select("length", "prefix").toArrow()
        of, prefixes = table.column(0).to_numpy(), table.column(1).to_numpy()
        return {n: np.sort(prefixes[of == n]) for n in set(of.tolist())}

    full = over((PAIR, PREFIXES[0]), None)
    if PREFIXES[0] in full:
        full |= over(PREFIXES[1:], spark.sparkContext.broadcast(full[PREFIXES[0]]))
    return total, full


def may_have(docs: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """``docs`` with ``may``: true for every row whose columns ``names`` (nulls alike) are a row of ``keys``, and for few others.

    The map is a bit for the low bits of each key's hash, in pages that are broadcast.
    """
    bits = PAGE_BITS
    for_each = 16 * keys.count()
    while bits < min(for_each, MOST_BITS):
        bits *= 2
    slot = F.xxhash64(*names).bitwiseAND(bits - 1)
    on_page, page = slot.bitwiseAND(PAGE_BITS - 1), F.shiftright(slot, PAGE_BITS.bit_length() - 1)
    pages = keys.select(page.alias("page"), on_page.alias("bit")).repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    told = docs.withColumn("page", page).withColumn("bit", on_page).join(F.broadcast(pages), "page", "left")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.col("bit").bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return told.withColumn("may", may).select(*docs.columns, "may")


def repeated_spans(docs: DataFrame, copies: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(t, span) of the texts that share windows with other texts or within themselves, a row for each span.

    ``docs`` has id, t (hash of the text) and text; ``copies`` has t and the id of one row with it.
    The second result are the tables that the first reads.
    """
    spark = docs.sparkSession
    anchors = docs.where("text IS NOT NULL").select("t", "text").mapInArrow(_find_anchors, "t long, phrase long, runs int")
    # Sums before the shuffle and a join that Spark can split: a phrase of very many texts is no task of its own.
    phrases = anchors.groupBy("phrase").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("runs").alias("most"))
    shared = phrases.where("a <> b OR most > 1").select("phrase")
    wanted = anchors.select("t", "phrase").join(shared, "phrase").groupBy("t").agg(F.collect_set("phrase").alias("found")).join(copies, "t")
    wanted = materialize(wanted.select("t", "id", "found"), "wanted")
    near = may_have(docs, wanted, "t", "id").where("may")
    texts = near.join(wanted.select("found", F.col("t").alias("t2"), F.col("id").alias("id2")), (F.col("t") == F.col("t2")) & F.col("id").eqNullSafe(F.col("id2"))).select("t", "text", "found")
    texts = materialize(texts.mapInArrow(_mark, "t long, text string, places binary, n long"), "suffix-texts")
    drop_materialized(wanted)
    total, full = full_prefixes(texts)
    parts = max(1, -(-total // PART))
    dealt = texts.select("t", "text", "places").mapInArrow(_deal(parts, spark.sparkContext.broadcast(full)), "part int, t long, lo int, hi int, blob binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_trees, "t long, span long"), [texts]


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed and the digest of the kept words; ``with_text`` adds them."""
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    copies = materialize(docs.where("text IS NOT NULL").groupBy("t").agg(F.min("id").alias("id"), F.count("*").alias("rows")), "copies")
    spans, read = repeated_spans(docs, copies.select("t", "id"))
    several = copies.where("rows > 1").select("t", F.lit(None).cast("long").alias("span"), "rows")
    told = several.unionByName(spans.withColumn("rows", F.lit(1).cast("long"))).groupBy("t").agg(F.max("rows").alias("rows"), F.collect_list("span").alias("spans"))
    told = materialize(told, "told")
    drop_materialized(copies, *read)
    near = may_have(docs, told, "t")
    met = near.where("may").drop("may").join(told, "t", "left").select("id", "text", F.coalesce("rows", F.lit(1)).alias("rows"), "spans")
    rest = near.where("NOT may").select("id", "text", F.lit(1).cast("long").alias("rows"), F.lit(None).cast("array<long>").alias("spans"))
    out = met.unionByName(rest)
    if with_text:
        cut = out.mapInArrow(_cut, f"id {id_type}, n_words long, n_removed long, kept_sha256 string, kept string")
    else:
        cut = out.mapInArrow(_cut_digests, f"id {id_type}, n_words long, n_removed long, kept_sha256 string")
    return cut.withColumnRenamed("id", id_col)


def oracle_sql() -> str:
    """Windows that start more than once, and the words that they cover, in DuckDB SQL over ``documents``."""
    blank = "[ \\t\\n\\x0B\\f\\r]+"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}'), lambda x: x <> '') AS w FROM documents
), words AS (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), s AS (
  SELECT r, p, string_agg(x, ' ') OVER f AS win, count(*) OVER f AS n FROM words WINDOW f AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), twice AS (
  SELECT win FROM s WHERE n = {WINDOW} GROUP BY win HAVING count(*) > 1
), starts AS (
  SELECT r, p FROM s SEMI JOIN twice USING (win)
), gone AS (
  SELECT DISTINCT r, p + k AS p FROM starts CROSS JOIN (SELECT unnest(range({WINDOW})) AS k)
), left_over AS (
  SELECT r, list(x ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(len(kept), 0) AS BIGINT) AS n_removed, sha256(array_to_string(coalesce(kept, []), ' ')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""
