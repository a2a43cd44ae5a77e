"""Near-duplicates, repeated passages, lines and vectors against brute force."""

from __future__ import annotations

import hashlib
import random

import brute
import numpy as np
import pytest

from quillmesh.llm import components, line_dedup, minhash_forest, queries, rp_forest, suffix_dedup
from quillmesh.llm.components import connected_components
from quillmesh.llm.grams import grams, shingle_set, word_hashes

SF = "/root/testdata/sf0.001"


def _corpus(seed, n=120):
    """Bases with copies, near copies at all distances, and passages that several texts share."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    bases = [[word() for _ in range(rng.randint(3, 150))] for _ in range(25)]
    passages = [[word() for _ in range(rng.randint(30, 60))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            if w:
                w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        text = "".join(x + rng.choice([" ", " ", "\n", "\t", "  "]) for x in w)
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates(spark, seed):
    rows = _corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(df).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_on_edges(edge, edge_rows, empty):
    got = minhash_forest.near_duplicates(edge).collect()
    want = brute.near_duplicates([(r[0] if r[0] is not None else -1, r[1]) for r in edge_rows])
    assert len(got) == len(edge_rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash_forest.near_duplicates(empty).count() == 0
    left = sorted((r.doc_id or -1) for r in minhash_forest.one_of_each(edge).collect())
    assert left == sorted({i if i is not None else -1 for i in (r[0] for r in edge_rows)} - {2, 3, 13} - ({12} if want[12][1] != 12 else set()) - ({19} if want[19][1] != 19 else set()))
    assert minhash_forest.one_of_each(edge).columns == edge.columns
    assert minhash_forest.one_of_each(empty).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(700):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_pairs_inside_a_template_crowd(spark):
    """All texts share a template just below the threshold; only the planted pairs are above it."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    template = " ".join(word() for _ in range(205))
    rows = []
    for k in range(150):
        common, n = [word() for _ in range(5)], rng.choice([34, 35])
        for j in range(2):
            rows.append((2 * k + j, " ".join([template, *common, *[word() for _ in range(n - 5)]])))
    for k in range(100):
        rows.append((300 + k, " ".join([template, *[word() for _ in range(35)]])))
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute.near_duplicates(rows)
    assert len({c for _, c in want.values()}) == 250
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = {"chain": [(k, k + 1) for k in range(60)], "star": [(0, k) for k in range(1, 50)] + [(70, 71)], "random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)]}[shape]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in brute.components(range(100), links).items() if k in nodes}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [0, 250_000])
@pytest.mark.parametrize("shape", ["chain", "hubs", "random"])
def test_components_in_rounds_and_at_once(spark, monkeypatch, shape, most):
    """Star rounds and the driver's arrays agree with brute force, for negative, repeated and self links too."""
    monkeypatch.setattr(components, "DRIVER_LINKS", most)
    rng = random.Random(4)
    names = [rng.randrange(-(2**63), 2**63) for _ in range(200)]
    links = {"chain": list(zip(names, names[1:])), "hubs": [(names[k % 5], x) for k, x in enumerate(names)], "random": [(rng.choice(names), rng.choice(names)) for _ in range(150)]}[shape]
    links += [*links[:9], *[(b, a) for a, b in links[:9]], (names[0], names[0])]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in brute.components(names, links).items() if k in nodes}


def test_components_of_few_links_take_few_jobs(spark):
    """Every job leaves plans and generated classes with the driver, however few its rows."""
    links = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    spark.sparkContext.setJobGroup("few-links", "few links")
    try:
        connected_components(links)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 6


def test_hashes_follow_the_words():
    a = word_hashes(b"one two\t\nthree  two one ")[2]
    assert len(a) == 5 and a[0] == a[4] and a[1] == a[3] and len(set(a.tolist())) == 3
    assert len(word_hashes(b"")[2]) == len(word_hashes(b" \n")[2]) == 0
    assert (word_hashes("Éa B".encode(), lower=True)[2][1] == word_hashes(b"b")[2][0]) and word_hashes("Éa".encode(), lower=True)[2][0] != word_hashes("éa".encode())[2][0]
    long = word_hashes(("pad " * 50_000 + "one").encode())[2]
    assert long[-1] == a[0] and len(grams(long, 5)) == len(long) - 4
    for text in (None, "", "a", "a b c d", "a b c d e", "A b c d e a B c d e"):
        assert len(shingle_set(text)) == len(brute.shingles(text))


@pytest.mark.parametrize("group", [2_000, 2])
@pytest.mark.parametrize("seed", range(2))
def test_repeated_passages(spark, monkeypatch, seed, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "PART", 100 * group)
    rows = [*_corpus(seed), (500, "loop " * 120), (501, "a b c " * 40), (502, "loop " * 36), (503, "loop " * 34)]
    got = sorted(tuple(r) for r in suffix_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == brute.substring_dedup(rows)


def test_repeated_passages_on_edges(edge, edge_rows, empty):
    got = sorted((tuple(r) for r in suffix_dedup.substring_dedup(edge).collect()), key=str)
    assert got == sorted(brute.substring_dedup([r[:2] for r in edge_rows]), key=str)
    assert suffix_dedup.substring_dedup(empty).count() == 0
    kept = {r.doc_id: r.kept for r in suffix_dedup.substring_dedup(edge, with_text=True).collect()}
    assert kept[7] == "Tiny" and kept[3] == "" and kept[14] == " ".join(brute.words(edge_rows[13][1]))


def _lines(rows, min_sites):
    """Lines on enough sites go; from a text that itself stands on enough sites only those that other texts carry as far."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r")
    whole, every, others = {}, {}, {}
    for _, text, site in rows:
        if text is not None:
            whole.setdefault(text, set()).add(site)
    copied = {t for t, s in whole.items() if len(s) >= min_sites}
    for _, text, site in rows:
        for x in (text or "").split("\n"):
            every.setdefault(key(x), set()).add(site)
            if text not in copied:
                others.setdefault(key(x), set()).add(site)
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, 0, 0, None))
            continue
        lines, sites = text.split("\n"), others if text in copied else every
        left = [x for x in lines if not key(x) or len(sites.get(key(x), ())) < min_sites or len(every[key(x)]) < min_sites]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def test_lines(spark, edge, edge_rows, empty):
    rng = random.Random(6)
    common = [f"common line number {k} of them" for k in range(8)]
    rows = []
    for i in range(150):
        own = [f"line {rng.random()} of its own with some words" for _ in range(rng.randint(0, 6))]
        own += rng.sample(common, rng.randint(0, 3)) + rng.choice([[], ["short"], [" "], [""]])
        rng.shuffle(own)
        rows.append((i, "\n".join(own), rng.choice([None, "", *"abcdefgh"]) if rng.random() < 0.6 else "a"))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == _lines(rows, line_dedup.MIN_SITES)
    assert any(r.n_removed for r in got)
    on_edge = line_dedup.line_dedup(edge).collect()
    want = _lines([(r[0], r[1], r[3]) for r in edge_rows], line_dedup.MIN_SITES)
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in on_edge), key=str) == sorted(want, key=str)
    assert line_dedup.line_dedup(edge).columns == [*edge.columns, "n_lines", "n_removed"] and line_dedup.line_dedup(empty).count() == 0


def test_short_lines_and_worst_carriers(spark):
    """Short boilerplate goes, also where it is most of the text; whole copies keep what is theirs."""
    short, long, own = "Share this", "Sign up for our weekly letter and offers", "An article that was copied whole to every site"
    rows = [(i, f"{short}\n{long}\nbody {i}", f"s{i}") for i in range(6)] + [(10 + i, f"{own}\n{short}", f"s{i}") for i in range(6)]
    rows += [(20, "a line\nthat few\nsites have", "s0"), (21, None, "s1"), (22, "", "s2")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = {i: (f"body {i}", 2) for i in range(6)} | {10 + i: (own, 1) for i in range(6)}
    assert got == want | {20: (rows[-3][1], 0), 21: (None, 0), 22: ("", 0)}


def test_lines_joined_by_shuffle(spark, monkeypatch):
    rows = [(i, f"the very same line everywhere\nown text number {i} that is longer than the line", str(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert {r.n_removed for r in line_dedup.line_dedup(df).collect()} == {1}


def _vectors(seed=0, width=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, width))
    for k in range(100, 220):
        x[k] = x[k % 40] + rng.normal(size=width) * rng.choice([0.02, 0.05, 0.08])
    x[220:240] = x[:20]
    x[240:250] = 3.5 * x[50:60]
    return x.astype(np.float32)


def _links(rows):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    u = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = u @ u.T >= rp_forest.COSINE
    n = {i: 0 for i, _ in rows}
    links = []
    for a, b in zip(*np.nonzero(near), strict=True):
        if a < b:
            links.append((ok[a][0], ok[b][0]))
            n[ok[a][0]] += 1
            n[ok[b][0]] += 1
    root = brute.components([i for i, _ in rows], links)
    return {i: (n[i], root[i]) for i, _ in rows}


@pytest.mark.parametrize("leaf,chunk", [(400, 2_000), (20, 2_000), (20, 15)])
def test_vectors(spark, monkeypatch, leaf, chunk):
    monkeypatch.setattr(rp_forest, "LEAF", leaf)
    monkeypatch.setattr(rp_forest, "CHUNK", chunk)
    rows = [(k, v.tolist()) for k, v in enumerate(_vectors())]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [None] * 16), (904, [float("nan")] * 16), (905, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, node int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest.near_duplicate_vectors(df).collect()}
    want = _links(rows)
    found, all_links = sum(x for x, _ in got.values()), sum(x for x, _ in want.values())
    assert found >= 0.99 * all_links and all(got[i][0] <= want[i][0] for i in got)
    if leaf == 400:
        assert got == want


def test_vectors_in_double_precision(spark):
    """Two unit vectors whose cosine is a hair below the threshold, which single precision would not see."""
    below, above = (np.array([c, np.sqrt(1 - c * c)]) for c in (0.95 - 1e-9, 0.95 + 1e-9))
    for v, n in ((below, 0), (above, 1)):
        df = spark.createDataFrame([(1, [1.0, 0.0]), (2, v.tolist())], "vec_id long, embedding array<double>")
        assert {r.n_links for r in rp_forest.near_duplicate_vectors(df).collect()} == {n}


def test_vectors_of_nothing(spark):
    assert rp_forest.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    odd = spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(((r.n_links, r.component_id) for r in rp_forest.near_duplicate_vectors(odd).collect()), key=str) == [(0, 1), (2, 2), (2, 2), (2, 2)]


def test_digest_of_the_query(spark):
    from quillmesh.llm.queries import op10_line_dedup

    r = op10_line_dedup(spark, "/root/testdata/sf0.001").first()
    assert len(r.kept_sha256) == len(hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, edge, tmp_path, name):
    """Each query against its SQL on the smallest tables, and where it reads documents on the edge cases with ids of their own."""
    import duckdb
    from pyspark.sql import functions as F

    own = edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    own.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    for folder, files in ((str(tmp_path), "/*.parquet"), (SF, "")):
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{files}'")
        df = queries.QUERIES[name](spark, folder)
        cursor = con.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == sorted(cursor.fetchall(), key=str)


def test_vectors_of_several_lengths(spark):
    """Vectors of each length are compared among themselves, whichever is the most frequent."""
    rows = [(k, [1.0, 0.01 * k, 0.0]) for k in range(5)] + [(10, [1.0, 0.0]), (11, [1.0, 0.001]), (20, [3.0]), (21, [5.0]), (22, [-1.0]), (30, [1.0, 0.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {k: (4, 0) for k in range(5)} | {10: (1, 10), 11: (1, 10), 20: (1, 20), 21: (1, 20), 22: (0, 22), 30: (0, 30)}


def test_vectors_of_the_driver_at_production_leaves(spark):
    """2,000 vectors in leaves of 400: nearly every link of brute force is found."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    assert len(rows) > 4 * rp_forest.LEAF
    got = {r.vec_id: r.n_links for r in rp_forest.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = _links(rows)
    assert sum(got.values()) >= 0.99 * sum(n for n, _ in want.values()) and all(got[i] <= n for i, (n, _) in want.items())


def test_regions_dealt_into_shares(spark, monkeypatch):
    """Near copies whose region of the forest is dealt out are still one group each."""
    monkeypatch.setattr(minhash_forest, "SPLIT", 20)
    rng = random.Random(3)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(90)]
        for i in range(80):
            w = list(base)
            w[rng.randrange(90)] = f"x{i}"
            rows.append((1000 * g + i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.near_duplicates(rows)


def test_a_long_chain_is_one_component(spark):
    """More links in a row than any fixed number of rounds would see, in no order."""
    names = list(range(3000))
    random.Random(8).shuffle(names)
    links = list(zip(names, names[1:]))
    assert {r.root for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()} == {0}


def test_suffixes_in_order():
    """Sorted suffixes and their common prefixes against plain tuples of words."""
    rng = random.Random(1)
    words = [rng.choice(["a", "b", "c"]) for _ in range(120)]
    words[60:105] = words[5:50]
    hashes = suffix_dedup._hashes(" ".join(words))
    place = np.arange(len(words) - suffix_dedup.WINDOW + 1)
    prefix, length, sure = suffix_dedup.Full({}).split(hashes, place)
    held = np.append((hashes & np.uint64(255)).astype(np.uint8), np.zeros(40, dtype=np.uint8))
    width = suffix_dedup.WINDOW - suffix_dedup.PREFIXES[0]
    path = np.stack([held[k + 8 : k + 8 + width] for k in place])
    blob = suffix_dedup._blobs([(prefix, length.astype(np.uint8), np.zeros(len(place), dtype=np.int64), place.astype(np.int32), grams(hashes, suffix_dedup.WINDOW).view(np.int64), path)], 1)
    rows = np.frombuffer(blob.column(4)[0].as_py(), dtype=suffix_dedup.SUFFIX)
    order, common = suffix_dedup.suffix_order(rows)
    at = rows["place"][order].tolist()

    def shared(x, y):
        n = 0
        while n < suffix_dedup.WINDOW and words[x + n] == words[y + n]:
            n += 1
        return n if n >= 8 else 0

    assert not sure.any() and common.tolist()[1:] == [shared(x, y) for x, y in zip(at, at[1:])]
    assert sum(c >= suffix_dedup.WINDOW for c in common.tolist()) >= 11


def _shuffled(spark, run):
    """Result of ``run`` and the bytes that its stages shuffled."""
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (found.apply(k) for k in range(found.size()))}

    before = stages()
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_repeated_passages_shuffle_little(spark):
    """Texts without repeats stay where they are, and suffixes take less room than the texts."""
    rng = random.Random(3)
    word = lambda: rng.choice(["stone", "river", "tree", "of", "the"]) + str(rng.randint(0, 2000))
    lists = [[word() for _ in range(300)] for _ in range(900)]
    for k in range(300):
        near = list(lists[k])
        near[rng.randrange(300)] = word()
        lists.append(near)
    rows = [(k, " ".join(x)) for k, x in enumerate(lists)]
    got, n = _shuffled(spark, lambda: suffix_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted(tuple(r) for r in got) == brute.substring_dedup(rows)
    assert n < 2 * sum(len(x) for _, x in rows)


def test_runs_of_suffixes_come_back():
    hashes = suffix_dedup._hashes(" ".join(f"w{k * k % 91}" for k in range(200)))
    place = np.flatnonzero(np.random.default_rng(4).random(len(hashes) - suffix_dedup.WINDOW + 1) < 0.8)
    letters = np.lib.stride_tricks.sliding_window_view((hashes & np.uint64(255)).astype(np.uint8), suffix_dedup.WINDOW)[place]
    prints = grams(hashes, suffix_dedup.WINDOW)[place].view(np.int64)
    rows = suffix_dedup._suffixes([(prints, np.zeros(len(place), dtype=np.uint8), np.full(len(place), -7), place.astype(np.int32), prints, letters[:, 8:])])
    blob = suffix_dedup.pack_runs(rows, letters, np.append(True, np.diff(place) != 1))
    back = suffix_dedup.unpack_runs(blob)
    assert all((back[x] == rows[x]).all() for x in ("t", "place", "print", "path"))
    assert (np.ascontiguousarray(back["prefix"]).view(np.uint8).reshape(-1, 8) == letters[:, :8]).all() and len(blob) < 25 * len(rows)


@pytest.mark.parametrize("most", [1 << 26, 1 << 15])
def test_no_key_is_lost_in_the_map(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_BITS", most)
    docs = spark.range(40_000).selectExpr("CASE WHEN id > 0 THEN id END AS id", "xxhash64(id) AS t")
    keys = docs.where("coalesce(id, 0) % 10 = 0")
    told = {r.id: r.may for r in suffix_dedup.may_have(docs, keys, "t", "id").collect()}
    assert len(told) == 40_000 and all(told[k or None] for k in range(0, 40_000, 10))
    assert sum(told.values()) < (4_000 + 4_000 if most > 1 << 15 else 12_000)
