"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_duplicates(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def substring_dedup(rows, window=35):
    own = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[j : j + window]) for _, w in own for j in range(len(w) - window + 1))
    out = []
    for i, w in own:
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


def quality(text):
    w = words(text)
    tri = list(zip(w, w[1:], w[2:]))
    seen = Counter(tri)
    covered = {k + d for k, t in enumerate(tri) if seen[t] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Sources (None last) to targets, by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


class _Article(HTMLParser):
    """Text of the first article element, block by block, by the standard library's parser."""

    BLOCKS = frozenset("article h1 h2 p br ul ol li div table tr td section".split())
    SKIP = frozenset("script style form nav aside footer".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in self.SKIP
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in self.SKIP
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


def article(html):
    parser = _Article()
    parser.feed(html or "")
    parser.close()
    return " ".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)


def language(net, raw):
    """Mean over all bytes of the softmax of a bidirectional gated network, one byte at a time."""
    hidden = net.recur.shape[1]
    sides = []
    for d in (0, 1):
        h, out = np.zeros(hidden), []
        for b in raw if d == 0 else raw[::-1]:
            x = net.table[d][b].astype(float)
            gates = 1 / (1 + np.exp(-(x[: 2 * hidden] + h @ net.recur[d][:, : 2 * hidden])))
            z, r = gates[:hidden], gates[hidden:]
            h = z * h + (1 - z) * np.tanh(x[2 * hidden :] + (r * h) @ net.recur[d][:, 2 * hidden :])
            out.append(h)
        sides.append(np.array(out if d == 0 else out[::-1]))
    logits = np.concatenate(sides, axis=1) @ net.out + net.bias
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return (e / e.sum(axis=1, keepdims=True)).mean(axis=0)


def toxic_score(model, text):
    """Logistic score of the three strongest words by their compressed lengths, each compressed afresh."""
    import zstandard

    from quillmesh.llm import toxicity

    own = set()
    for w in (text or "").lower().encode("utf-8", "replace").split():
        own.add(w.strip(toxicity.EDGE))
    own.discard(b"")
    values = []
    for w in own:
        sizes = []
        for content in (model.ordinary, model.toxic):
            parameters = zstandard.ZstdCompressionParameters(**toxicity.PARAMETERS)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=parameters)
            sizes.append(len(zstandard.ZstdCompressor(compression_params=parameters, dict_data=d).compress((b" " + w) * toxicity.REPEATS + b" ")))
        margin = min(max(sizes[0] - sizes[1], 0), toxicity.WIDEST)
        values.append(float(model.cells[min(len(w), toxicity.LONGEST), margin]))
    top = sorted([v for v in values if v > 0], reverse=True)[:3]
    z = float(np.dot(model.weights, [*top, *[0.0] * (3 - len(top)), math.log1p(len(own))])) + model.bias
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
