"""MinHash near-dedup with an LSH forest.

Every text becomes the set of its five-word shingles and a MinHash signature.  Texts with equal
sets are one node.  Each tree of the forest orders the nodes by its own slice of the signature;
nodes are candidates where they share the first ``ROOT`` values and stand next to each other in
that order, so the longest common prefixes come first.  The depth is adaptive: a region with few
nodes compares all of them at the root's depth, a fuller one asks for longer common prefixes and
begins with the nearest few.  Regions over ``SPLIT`` nodes are dealt into shares by the next values
of the signature and a hash, so that none is one task; what a share parts, other trees and the exact
join bring together.

Each node first meets the smaller neighbour that stands next to it in most trees: at most one pair
a node, however large its group.  The forest is then read again with the components so found, and
only neighbours of different components meet.  Candidates whose byte sketches say that they are far
apart go; the others are confirmed on the full sets.  The nodes of full regions are then joined
exactly, whatever their number:
two sets of the similarity share a shingle among the rarest of each, at places that their sizes
allow.  Only pairs of different components are formed there, so a large group of near copies,
which the forest has linked already, forms none.

Nulls and edges: null text and text without words has an empty set and links with nothing; rows
of one id are judged by their texts; a null id has a null component unless its text has copies
with ids, and stays; ties go to the smaller id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import materialize, ship
from quillmesh.llm.components import connected_components
from quillmesh.llm.grams import mix, shingle_set

SHINGLE = 5
SIMILARITY = 75  # per cent
TREES, DEPTH, ROOT = 16, 5, 2
#: Nodes of a region up to which all are compared; of a full one, up to which one more value is enough.
REGION, CROWD = 16, 512
#: Nodes of a region that stay together in one task, and regions above it that may be broadcast.
SPLIT, BROADCAST_REGIONS = 4_096, 200_000
#: Neighbours in the order that a node meets first, in a small region (all) and in a full one.
WIDE, NARROW = REGION - 1, 3
#: Counters by which the exact join orders shingles from rare to frequent.
BUCKETS = 1 << 18
#: Ratio of the bands of set sizes that meet in the exact join.
SIZE_BAND = 1.02
#: Share of equal sketch bytes under which a pair is out: six deviations below the threshold.
SKETCH = 0.45
#: Ids that may be broadcast (16 MB).
BROADCAST_IDS = 1_000_000

_A = np.random.default_rng(20240503).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(20240504).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values (32 bits) of a set."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), 2048):
        part = shingles[lo : lo + 2048, None] * _A[None, :]
        part += _B[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def _node(shingles: np.ndarray) -> int:
    """Hash of a set."""
    return int(mix(shingles * _A[0] + _B[1]).sum(dtype=np.uint64).astype(np.int64))


def _signatures(df: DataFrame) -> DataFrame:
    """Per row: id, set size, hash of the set (null if empty), signature and byte sketch."""
    id_type = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, signs, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, SHINGLE)
                sizes.append(len(found))
                if len(found):
                    sign = signature(found)
                    nodes.append(_node(found))
                    signs.append(sign.astype(">u4").tobytes())
                    sketches.append(sign.astype(np.uint8).tobytes())
                else:
                    nodes.append(None)
                    signs.append(None)
                    sketches.append(None)
            columns = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signs, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["id", "t", "n", "node", "sign", "sketch"])

    return df.select("id", "text", "t").mapInArrow(run, f"id {id_type}, t long, n long, node long, sign binary, sketch binary")


def _candidates(nodes: DataFrame) -> DataFrame:
    """Distinct (a, b, trees), a < b, of nodes of different roots that are neighbours in some trees.

    ``nodes`` has (node, n, sign, root); sizes that rule the similarity out form no
    pair.  For each node of a full region there is (a, a) too.
    """
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = nodes.select("node", "root", "n", "sign", tree.alias("tree"))
    at = F.col("tree") * (4 * DEPTH) + 1
    rows = rows.select(
        "node", "root", "n", "tree", F.substring("sign", at, F.lit(4 * ROOT)).alias("prefix"), F.substring("sign", at + 4 * ROOT, F.lit(4 * (DEPTH - ROOT))).alias("rest")
    )
    wide = materialize(rows.groupBy("tree", "prefix").agg(F.count("*").alias("all")).where(F.col("all") > SPLIT), "wide-regions")
    rows = rows.join(F.broadcast(wide) if wide.count() <= BROADCAST_REGIONS else wide, ["tree", "prefix"], "left")
    next_values = F.xxhash64(F.substring("rest", F.lit(1), F.lit(8)))
    rows = rows.withColumn("share", F.when(F.col("all").isNotNull(), F.xxhash64(next_values, F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("all") / SPLIT)))))
    region = Window.partitionBy("tree", "prefix", "share")
    order = region.orderBy("rest", "node")
    held = F.coalesce("all", F.count("*").over(region))
    near = rows.withColumn("region", held).withColumn("near", F.collect_list(F.struct("node", "root", "n", "rest")).over(order.rowsBetween(-WIDE, 0)))
    other = F.filter("near", lambda x: (x["root"] != F.col("root")) | (x["node"] == F.col("node")))
    near = near.where(F.col("region") > 1).withColumn("near", other)
    full = F.col("region") > REGION
    # The last one of the list is the node itself, and those before it stand nearest.
    take = F.when(full, F.lit(NARROW)).otherwise(F.lit(WIDE)) + 1
    near = near.select("node", "n", "region", "rest", F.explode(F.slice("near", F.greatest(F.size("near") - take + 1, F.lit(1)), F.lit(WIDE + 1))).alias("x"))
    near = near.where(full | (F.col("node") != F.col("x.node")))
    near = near.where(100 * F.least("n", "x.n") >= SIMILARITY * F.greatest("n", "x.n"))
    depth = F.when(~full, F.lit(0)).when(F.col("region") <= CROWD, F.lit(4)).otherwise(F.lit(8))
    near = near.where(F.substring("rest", F.lit(1), depth) == F.substring("x.rest", F.lit(1), depth))
    return near.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).groupBy("a", "b").agg(F.count("*").alias("trees"))


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, equal sketch bytes) of the pairs that may reach the similarity."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    joined = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches = [np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for k in (2, 3)]
            equal = (sketches[0] == sketches[1]).sum(axis=1)
            keep = pa.array(equal >= SKETCH * len(_A))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal.astype(np.int32))], ["a", "b", "equal"])
            yield out.filter(keep)

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, equal int")


def _texts(nodes: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """(id, text) of the rows of ``docs`` that hold ``nodes``; ``first`` has one id per node."""
    wanted = materialize(nodes.join(first, "node").select("id").distinct(), "wanted")
    return docs.select("id", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id", "left_semi")


def _shared_rare(crowd: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of all nodes of ``crowd`` (node, root) of different roots that may reach the similarity.

    Each set in one order, rare shingles first: the first one that two sets share has at least the
    overlap that the similarity asks for, ``SIMILARITY / (100 + SIMILARITY)`` of both sizes, from
    its place to the end of either.  So a place bounds the other set's size, and a shingle of a
    common template, late in the order, brings no sets of like size together.
    """
    texts = materialize(_texts(crowd.select("node"), docs, first), "crowd")
    mask = np.uint64(BUCKETS - 1)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts += np.bincount((shingle_set(text, SHINGLE) & mask).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["bucket", "c"])

    tallied = texts.select("text").mapInArrow(tally, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[tallied.column("bucket").to_numpy()] = tallied.column("c").to_numpy()

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                nodes, sizes, at, tokens = ([np.empty(0, dtype=np.int64)] for _ in range(4))
                for text in batch.column(0).slice(lo, 256).to_pylist():
                    found = shingle_set(text, SHINGLE)
                    n = len(found)
                    if n:
                        k = n - -(-SIMILARITY * n // 100) + 1
                        nodes.append(np.full(k, _node(found), dtype=np.int64))
                        sizes.append(np.full(k, n, dtype=np.int64))
                        at.append(np.arange(k, dtype=np.int64))
                        tokens.append(found[np.lexsort((found, counts[found & mask]))[:k]].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, sizes, at, tokens)], ["node", "n", "at", "token"])

    rows = texts.select("text").mapInArrow(rarest, "node long, n long, at long, token long").join(crowd, "node")
    rows = materialize(rows, "rarest")
    several = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("token")
    several = materialize(several, "shared")
    rows = rows.join(F.broadcast(several) if several.count() <= BROADCAST_IDS else several, "token", "left_semi")

    # The other set's size, as the sizes' ratio and the place allow it.
    both = 100 + SIMILARITY
    least = f"(({SIMILARITY} * n + 99) div 100)"
    most = f"least(100 * n div {SIMILARITY}, {both} * (n - at) div {SIMILARITY} - n)"
    rows = rows.withColumn("least", F.expr(least)).withColumn("most", F.expr(most))

    def band(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / float(np.log(SIZE_BAND)))

    def side(name: str, low: Column, high: Column) -> DataFrame:
        spread = rows.where(low <= high).withColumn("own", band(F.col("n"))).withColumn("other", F.explode(F.sequence(band(low), band(high))))
        key = [F.col("own").alias("x"), F.col("other").alias("y")] if name == "p" else [F.col("other").alias("x"), F.col("own").alias("y")]
        return spread.select("token", *key, *[F.col(c).alias(f"{name}_{c}") for c in ("node", "root", "n", "least", "most")])

    shorter = side("p", F.col("n"), F.col("most"))
    longer = side("q", F.col("least"), F.least("n", "most"))
    met = shorter.join(longer, ["token", "x", "y"]).where(
        "p_root <> q_root AND (p_n < q_n OR p_n = q_n AND p_node < q_node) AND q_n <= p_most AND p_n >= q_least AND p_n <= q_most"
    )
    return met.select(F.least("p_node", "q_node").alias("a"), F.greatest("p_node", "q_node").alias("b")).distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    ``first`` has one id per node; the sets are read again from the texts of those rows alone.
    """
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = [shingle_set(t, SHINGLE) for t in batch.column(1).slice(lo, 256).to_pylist()]
                keys = [_node(s) if len(s) else None for s in sets]
                values = np.concatenate([np.empty(0, dtype=np.uint64), *sets]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "shingles"])

    sets = texts.mapInArrow(run, "node long, shingles array<long>").where("node IS NOT NULL")
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    # Compared inside the JVM row by row: batches of two whole sets a row would cost memory.
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = joined.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared"), (F.size("sa") + F.size("sb")).alias("both"))
    return shared.where(100 * F.col("shared") >= SIMILARITY * (F.col("both") - F.col("shared"))).select("a", "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable) and kept.

    ``group`` tells the component by content (null without words) and ``t`` is the text's hash,
    for callers whose ids repeat.
    """
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    signed = materialize(_signatures(docs), "signatures")
    first = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    nodes = signed.where("node IS NOT NULL").dropDuplicates(["node"]).select("node", "n", "sign", "sketch")

    # Each node with one smaller neighbour: a forest of at most one pair per node, whatever its group.
    met = _candidates(nodes.withColumn("root", F.col("node")))
    rank = F.when(F.col("a") < F.col("b"), F.struct("trees", F.bitwise_not("a")))
    met = materialize(met.groupBy("b").agg(F.max_by("a", rank).alias("a"), F.max(F.col("a") == F.col("b")).alias("full")), "met")
    crowd, best = met.where("full").select(F.col("b").alias("node")), met.where("a IS NOT NULL").select("a", "b")
    sure = materialize(_confirmed(materialize(_alike(best, nodes), "alike"), docs, first), "links")
    roots = connected_components(sure)
    # Of the other neighbours only those that would connect two components can change the result.
    parted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_pairs = _candidates(parted).where("a < b").join(best, ["a", "b"], "left_anti")
    more = materialize(_confirmed(materialize(_alike(open_pairs, nodes), "open"), docs, first), "links")
    links = sure
    if more.limit(1).count():
        links = sure.unionAll(more)
        roots = connected_components(links)
    if crowd.limit(1).count():
        crowd = crowd.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rest = materialize(_alike(_shared_rare(crowd, docs, first), nodes), "alike")
        rest = materialize(_confirmed(rest, docs, first), "links")
        if rest.limit(1).count():
            roots = connected_components(links.unionAll(rest))
    rooted = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    component = rooted.select("node", "root").join(smallest, "root").select("node", "root", "component_id")
    out = signed.select("id", "t", "n", "node").join(component, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("root").alias("group"), "t")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each group the one with the smallest id, and all without words."""
    found = near_duplicates(df, id_col, text_col)
    chosen = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col("t"))).alias("x"))
    stay = chosen.select(F.col("x.i").alias("__i"), F.col("x.t").alias("__t")).distinct()
    empty = found.where("group IS NULL").select(F.col(id_col).alias("__i"), F.col("t").alias("__t")).distinct()
    keyed = df.withColumns({"__id": F.col(id_col), "__h": F.xxhash64(text_col)})
    on = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__t"))
    # Twins in id and text may differ elsewhere: the first by the whole row's hash stays.
    twin = F.row_number().over(Window.partitionBy("__id", "__h").orderBy(F.xxhash64(*df.columns)))
    return keyed.join(stay.unionAll(empty), on, "left_semi").withColumn("__twin", twin).where("__twin = 1").select(*df.columns)


def oracle_sql() -> str:
    """Links by full sets and their components in DuckDB SQL over ``documents``."""
    blank = "[ \\t\\n\\x0B\\f\\r]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '{blank}'), lambda x: x <> '') AS w FROM documents
), words AS (
  SELECT r, len(w) AS size, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), grams AS (
  SELECT r, size, p, string_agg(x, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {SHINGLE - 1} FOLLOWING) AS g FROM words
), sets AS (
  SELECT r, list_sort(list(DISTINCT g)) AS s FROM grams WHERE p = 1 OR p <= size - {SHINGLE - 1} GROUP BY r
), s AS (
  SELECT doc_id, coalesce(s, []) AS s FROM d LEFT JOIN sets USING (r)
), n AS (
  SELECT s, min(doc_id) AS node, len(s) AS size FROM s WHERE len(s) > 0 GROUP BY s
), x AS (
  SELECT node, size, unnest(s) AS g FROM n
), links AS (
  SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node, a.size, b.size
  HAVING 100 * count(*) >= {SIMILARITY} * (a.size + b.size - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, root) AS (
  SELECT node, node FROM n UNION SELECT b, root FROM reach JOIN both_ways ON a = node
), roots AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(root, s.doc_id) AS component_id, s.doc_id = coalesce(root, s.doc_id) AS kept
FROM s LEFT JOIN n ON n.s = s.s LEFT JOIN roots ON roots.node = n.node
"""
