"""Registered queries of the analytics engine and their DuckDB SQL.

The tables hold no citation graph, so the bipartite order -> part graph stands for it: an order
is a citing node, a part a cited one, ``embeddings`` by id are the features (parts beyond them
have none), conversations are context groups.  Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text, vectors
from quillmesh.functions.encode import encode, tokenise
from quillmesh.functions.towers import ContextTower, PaperTower, embed
from quillmesh.operators import graph, metrics, propagate, records, retrieval
from quillmesh.plans import lifecycle
from quillmesh.sources import json_maps, turtle

WIDTH = 64
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from quillmesh.plans.session import ship

    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs of the analogy -------------------------------------------------------------------


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("paper_id"), vectors.double(F.col("embedding")).alias("emb"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector asks for the one with the next id; the last one has no target."""
    c = _candidates(spark, d)
    return c.select(F.col("paper_id").alias("query_id"), (F.col("paper_id") + 1).alias("cited_paper_id"), "emb")


def _cited(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(1.0).alias("w"))
    return graph.coalesce_edges(lines)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vectors.double(F.col("embedding")).alias("vec"))


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """The order -> part graph and the part names as a triple set."""
    lines = _table(spark, d, "lineitem")
    order, part = F.concat(F.lit("u:/citation/o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("u:/paper/p"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("u:/paper/s"), F.col("l_suppkey").cast("string"))
    iri = lambda p, s, o: lines.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"))
    return iri("cites", supplier, part).unionAll(iri("hasCited", order, part)).unionAll(iri("hasCiting", order, supplier)).distinct()


VOCABULARY = graph.Vocabulary("u:/paper/", "u:/citation/", cites="cites", is_cited_by="isCitedBy", has_citing="hasCiting", has_cited="hasCited", has_context="hasContext", title="title")

_SQL_TRIPLES = """t AS (
  SELECT DISTINCT * FROM (
    SELECT 'u:/paper/s' || l_suppkey AS s, 'cites' AS p, 'u:/paper/p' || l_partkey AS o FROM lineitem
    UNION ALL SELECT 'u:/citation/o' || l_orderkey, 'hasCited', 'u:/paper/p' || l_partkey FROM lineitem
    UNION ALL SELECT 'u:/citation/o' || l_orderkey, 'hasCiting', 'u:/paper/s' || l_suppkey FROM lineitem)
)"""
_SQL_UNIT = "list_transform({v}::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])), 1e-12))"
_SQL_RANKS = f"""e AS (SELECT vec_id AS id, {_SQL_UNIT.format(v='embedding')} AS u FROM embeddings),
q AS (SELECT a.id AS query_id, b.id AS target_id, a.u, round(list_dot_product(a.u, b.u), 10) AS s FROM e a JOIN e b ON b.id = a.id + 1),
ranks AS (
  SELECT query_id, target_id AS cited_paper_id, CAST(1 + count(*) FILTER (WHERE c.id <> q.target_id AND round(list_dot_product(q.u, c.u), 10) > q.s) AS BIGINT) AS rank
  FROM q CROSS JOIN e c GROUP BY ALL
)"""
_SQL_EDGES = "edges AS (SELECT l_orderkey AS src, l_partkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2)"
_SQL_VALUES = "vals AS (SELECT vec_id AS id, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def _sql_propagated(edges: str) -> str:
    """(id, dim, value) of the weighted mean over ``edges``; neighbours without a vector count as zero."""
    return f"""deg AS (SELECT src, greatest(sum(w), 1e-9) AS degree FROM {edges} GROUP BY src),
summed AS (SELECT src, dim, sum(w * x) AS s FROM {edges} JOIN vals ON dst = vals.id GROUP BY src, dim),
dims AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS dim)
SELECT deg.src AS id, dims.dim, round(coalesce(s, 0) / degree, 6) + 0.0 AS value
FROM deg CROSS JOIN dims LEFT JOIN summed ON summed.src = deg.src AND summed.dim = dims.dim"""


# --- retrieval -------------------------------------------------------------------------------


@query(f"WITH {_SQL_RANKS} SELECT * FROM ranks")
def retrieval_rank(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rank_targets(_queries(spark, d), _candidates(spark, d))


@query(f"""WITH {_SQL_RANKS}
SELECT round(avg(CAST(rank <= 1 AS INTEGER)), 6) AS recall_at_1, round(avg(CAST(rank <= 5 AS INTEGER)), 6) AS recall_at_5,
  round(avg(CAST(rank <= 10 AS INTEGER)), 6) AS recall_at_10, round(avg(CAST(rank <= 20 AS INTEGER)), 6) AS recall_at_20,
  round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(1.0::DOUBLE / log2(rank + 1)), 6) AS ndcg_uncut,
  round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg_at_10, count(*) AS n_queries FROM ranks""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.ranking_metrics(retrieval.rank_targets(_queries(spark, d), _candidates(spark, d)))
    return out.select(*[c if c == "n_queries" else F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {_SQL_RANKS}, n AS (SELECT count(*) AS total FROM ranks)
SELECT bucket, n, round(n::DOUBLE / total, 6) AS share FROM (
  SELECT '=1' AS bucket, count(*) FILTER (WHERE rank = 1) AS n FROM ranks UNION ALL SELECT '<=5', count(*) FILTER (WHERE rank <= 5) FROM ranks
  UNION ALL SELECT '<=10', count(*) FILTER (WHERE rank <= 10) FROM ranks UNION ALL SELECT '>100', count(*) FILTER (WHERE rank > 100) FROM ranks) CROSS JOIN n""")
def rank_distribution(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rank_distribution(retrieval.rank_targets(_queries(spark, d), _candidates(spark, d)))


@query(f"""WITH {_SQL_RANKS}
SELECT list_sort(list(rank))[CAST(count(*) // 2 + 1 AS BIGINT)] AS median_rank, round(avg(rank), 6) AS mean_rank FROM ranks""")
def median_rank(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.median_rank(retrieval.rank_targets(_queries(spark, d), _candidates(spark, d)))
    return out.select("median_rank", F.round("mean_rank", 6).alias("mean_rank"))


_SQL_TOP = f"""e AS (SELECT vec_id AS id, {_SQL_UNIT.format(v='embedding')} AS u FROM embeddings),
s AS (SELECT a.id AS query_id, b.id AS paper_id, round(list_dot_product(a.u, b.u), 10) AS score FROM e a CROSS JOIN e b),
top AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS INTEGER) AS rank, paper_id, score FROM s
  QUALIFY rank <= 10)"""


@query(f"WITH {_SQL_TOP} SELECT query_id, rank, paper_id, round(score, 6) AS score FROM top")
def topk_recommend(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_k(_queries(spark, d), _candidates(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {_SQL_TOP}
SELECT query_id, rank, round(score, 4) AS score, paper_id,
  coalesce(nullif(CASE WHEN p_size > 25 THEN p_name END, ''), nullif(substring(string_split(text, chr(10))[1], 1, 300), ''), '(no title)') AS title
FROM top LEFT JOIN part ON p_partkey = paper_id LEFT JOIN documents ON doc_id = paper_id""")
def topk_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    titles = _table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    abstracts = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.with_metadata(retrieval.top_k(_queries(spark, d), _candidates(spark, d), 10), titles, abstracts)


@query("SELECT l_orderkey AS query_id, l_partkey AS cited_paper_id FROM lineitem WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings)")
def skipped_targets(spark: SparkSession, d: str) -> DataFrame:
    asked = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("cited_paper_id"))
    return retrieval.skipped(asked, _candidates(spark, d)).select("query_id", "cited_paper_id")


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    parts = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return parts.join(_features(spark, d), "id", "left_anti")


@query("SELECT CAST(count(*) AS BIGINT) AS n_queries, CAST(count(*) FILTER (WHERE b.vec_id IS NULL) AS BIGINT) AS n_skipped FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def answerable_queries(spark: SparkSession, d: str) -> DataFrame:
    asked = _queries(spark, d).select("query_id", "cited_paper_id")
    known = _candidates(spark, d).select(F.col("paper_id").alias("cited_paper_id"), F.lit(1).alias("known"))
    return asked.join(known, "cited_paper_id", "left").agg(F.count("*").alias("n_queries"), F.count_if(F.col("known").isNull()).alias("n_skipped"))


# --- graph -----------------------------------------------------------------------------------


@query(f"""WITH {_SQL_TRIPLES} SELECT p, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY p""")
def triple_counts(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).groupBy("p").agg(F.count("*").alias("n"))


@query(f"""WITH {_SQL_TRIPLES}, papers AS (SELECT s AS uri, true AS c FROM t WHERE p = 'cites' UNION ALL SELECT o, false FROM t WHERE p = 'cites')
SELECT 'paper' AS kind, uri, bool_or(c) AS is_corpus, CAST(row_number() OVER (ORDER BY uri) - 1 AS BIGINT) AS id FROM papers GROUP BY uri
UNION ALL SELECT 'citation', uri, NULL, CAST(row_number() OVER (ORDER BY uri) - 1 AS BIGINT) FROM (SELECT DISTINCT s AS uri FROM t WHERE p IN ('hasCited', 'hasCiting'))""")
def node_index(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_index(_triples(spark, d), VOCABULARY)


@query(f"""WITH {_SQL_TRIPLES}, corpus AS (SELECT DISTINCT s AS uri FROM t WHERE p = 'cites'), every AS (SELECT uri FROM corpus UNION SELECT o FROM t WHERE p = 'cites')
SELECT uri FROM every EXCEPT SELECT uri FROM corpus""")
def corpus_external(spark: SparkSession, d: str) -> DataFrame:
    return graph.paper_nodes(_triples(spark, d), VOCABULARY).where("NOT is_corpus").select("uri")


@query(f"""WITH {_SQL_TRIPLES}, papers AS (SELECT uri, row_number() OVER (ORDER BY uri) - 1 AS id FROM (SELECT s AS uri FROM t WHERE p = 'cites' UNION SELECT o FROM t WHERE p = 'cites'))
SELECT CAST(a.id AS BIGINT) AS src, CAST(b.id AS BIGINT) AS dst, 1.0::DOUBLE AS w FROM t JOIN papers a ON a.uri = s JOIN papers b ON b.uri = o WHERE p = 'cites'""")
def edges_encoded(spark: SparkSession, d: str) -> DataFrame:
    triples = _triples(spark, d)
    papers = graph.dense_ids(graph.paper_nodes(triples, VOCABULARY), ["uri"])
    return graph.edges(triples, "cites", papers, papers)


@query(f"WITH {_SQL_EDGES} SELECT * FROM edges")
def edges_coalesced(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d)


@query(f"WITH {_SQL_EDGES} SELECT src, sum(w) AS degree FROM edges GROUP BY src")
def row_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.row_degree(_cited(spark, d))


@query(f"WITH {_SQL_EDGES} SELECT src, dst, round(w / greatest(sum(w) OVER (PARTITION BY src), 1e-9), 6) AS w FROM edges")
def row_normalised(spark: SparkSession, d: str) -> DataFrame:
    return graph.row_normalise(_cited(spark, d)).withColumn("w", F.round("w", 6))


_SQL_COCITED = "co AS (SELECT a.dst AS src, b.dst AS dst, sum(a.w * b.w) AS w FROM edges a JOIN edges b ON a.src = b.src AND a.dst <> b.dst GROUP BY 1, 2)"


@query(f"WITH {_SQL_EDGES}, {_SQL_COCITED} SELECT w, CAST(count(*) AS BIGINT) AS pairs FROM co GROUP BY w")
def cocitation_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.cocitation(_cited(spark, d)).groupBy("w").agg(F.count("*").alias("pairs"))


@query(f"WITH {_SQL_EDGES}, {_SQL_COCITED} SELECT src, dst, round(w / greatest(sum(w) OVER (PARTITION BY src), 1e-9), 6) AS w FROM co")
def pcp_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.row_normalise(graph.cocitation(_cited(spark, d))).withColumn("w", F.round("w", 6))


# --- features --------------------------------------------------------------------------------


@query(f"WITH {_SQL_EDGES}, {_SQL_VALUES}, {_sql_propagated('edges')}")
def propagate_pp(spark: SparkSession, d: str) -> DataFrame:
    return vectors.explode_vector(propagate.metapath_pp(_cited(spark, d), _features(spark, d), WIDTH), ["id"])


@query(f"WITH {_SQL_EDGES}, {_SQL_VALUES}, {_SQL_COCITED}, {_sql_propagated('co')}")
def propagate_pcp(spark: SparkSession, d: str) -> DataFrame:
    return vectors.explode_vector(propagate.metapath_pcp(_cited(spark, d), _features(spark, d), WIDTH), ["id"])


@query(f"WITH {_SQL_EDGES}, {_SQL_VALUES}, back AS (SELECT dst AS src, src AS dst, w FROM edges), {_sql_propagated('back')}")
def propagate_pccon(spark: SparkSession, d: str) -> DataFrame:
    return vectors.explode_vector(propagate.metapath_pccon(_cited(spark, d), _features(spark, d), WIDTH), ["id"])


@query(f"""WITH {_SQL_VALUES}, dims AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS dim)
SELECT p_partkey AS id, dims.dim, round(coalesce(x, 0), 6) + 0.0 AS value FROM part CROSS JOIN dims LEFT JOIN vals ON vals.id = p_partkey AND vals.dim = dims.dim""")
def assemble_features(spark: SparkSession, d: str) -> DataFrame:
    parts = _table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return vectors.explode_vector(propagate.assemble(parts, _features(spark, d), WIDTH), ["id"])


@query("SELECT p_partkey AS id FROM part JOIN embeddings ON vec_id = p_partkey WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0")
def nonzero_rows(spark: SparkSession, d: str) -> DataFrame:
    parts = _table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return propagate.nonzero_rows(propagate.assemble(parts, _features(spark, d), WIDTH)).select("id")


@query(f"WITH {_SQL_VALUES} SELECT l_suppkey AS id, dim, round(avg(x), 6) + 0.0 AS value FROM lineitem JOIN vals ON vals.id = l_partkey GROUP BY 1, 2")
def mean_pool_passages(spark: SparkSession, d: str) -> DataFrame:
    passages = _table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("id"))
    joined = passages.join(_features(spark, d).withColumnRenamed("id", "l_partkey"), "l_partkey")
    return vectors.explode_vector(propagate.mean_pool(joined, "id"), ["id"])


@query("SELECT p_partkey AS id, CAST(count(l_orderkey) AS BIGINT) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def contexts_per_paper(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey")
    return _table(spark, d, "part").select("p_partkey").join(lines, "p_partkey", "left").groupBy(F.col("p_partkey").alias("id")).agg(F.count("l_orderkey").alias("n"))


@query(f"WITH u AS (SELECT vec_id AS id, {_SQL_UNIT.format(v='embedding')} AS u FROM embeddings) SELECT id, CAST(unnest(range(len(u))) AS INTEGER) AS dim, round(unnest(u), 6) + 0.0 AS value FROM u")
def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    return vectors.explode_vector(_features(spark, d).withColumn("vec", vectors.l2_normalise(F.col("vec"))), ["id"])


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_max(embedding::DOUBLE[]) AS m, list_avg(embedding::DOUBLE[]) AS a FROM embeddings),
x AS (SELECT id, list_transform(v, lambda y: exp(y - m)) AS s, list_transform(v, lambda y: y - a) AS c FROM e)
SELECT id, CAST(unnest(range(len(s))) AS INTEGER) AS dim, round(unnest(list_transform(s, lambda y: y / list_sum(s))), 6) + 0.0 AS softmax,
  round(unnest(list_transform(c, lambda y: y / sqrt(list_dot_product(c, c) / len(c) + 1e-5))), 6) + 0.0 AS layer_norm FROM x""")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    both = F.arrays_zip(vectors.softmax(F.col("vec")).alias("s"), vectors.layer_norm(F.col("vec")).alias("n"))
    rows = _features(spark, d).select("id", F.posexplode(both).alias("dim", "x"))
    return rows.select("id", "dim", (F.round("x.s", 6) + 0.0).alias("softmax"), (F.round("x.n", 6) + 0.0).alias("layer_norm"))


# --- records ---------------------------------------------------------------------------------

_SQL_CONTEXTS = """ctx AS (SELECT CASE WHEN turn = 1 THEN '  ' ELSE text END AS context, 'u:/paper/' || (conv_id * 7 + turn) AS cited_uri, 'u:/paper/c' || conv_id AS citing_uri,
  CAST(turn AS INTEGER) AS citing_idx, CASE WHEN role = 'system' THEN '' ELSE role END AS citation_type, CASE WHEN conv_id % 10 = 9 THEN NULL ELSE conv_id END AS context_group_id, conv_id, turn FROM conversations),
papers AS (SELECT 'u:/paper/' || p_partkey AS uri, p_partkey AS id FROM part),
res AS (SELECT ctx.*, id AS paper_id, (coalesce(regexp_matches(context, '[^ \\t\\n\\r\\f\\v]'), false) AND coalesce(citation_type <> '', false) AND context_group_id IS NOT NULL AND id IS NOT NULL) AS valid FROM ctx LEFT JOIN papers ON uri = cited_uri)"""


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "conversations")
    return c.select(
        F.when(F.col("turn") == 1, F.lit("  ")).otherwise(F.col("text")).alias("context"), F.concat(F.lit("u:/paper/"), (F.col("conv_id") * 7 + F.col("turn")).cast("string")).alias("cited_uri"),
        F.concat(F.lit("u:/paper/c"), F.col("conv_id").cast("string")).alias("citing_uri"), F.col("turn").cast("int").alias("citing_idx"),
        F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("role")).alias("citation_type"), F.when(F.col("conv_id") % 10 != 9, F.col("conv_id")).alias("context_group_id"), "conv_id", "turn",
    )


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.concat(F.lit("u:/paper/"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_partkey").alias("id"))


@query(f"WITH {_SQL_CONTEXTS} SELECT trim(context) AS context_text, paper_id AS cited_paper_id, cited_uri, citing_uri, citation_type, context_group_id FROM res WHERE valid")
def valid_records(spark: SparkSession, d: str) -> DataFrame:
    return records.citation_records(_contexts(spark, d), _papers(spark, d))


@query(f"WITH {_SQL_CONTEXTS} SELECT CAST(count(*) AS BIGINT) AS raw, CAST(count(*) FILTER (WHERE valid) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE NOT valid) AS BIGINT) AS skipped FROM res")
def record_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.record_counts(_contexts(spark, d), _papers(spark, d))


@query(f"""WITH {_SQL_CONTEXTS}, cit AS (SELECT DISTINCT 'u:/citation/c' || conv_id || '/' || turn AS uri, conv_id * 100 + turn AS id FROM conversations)
SELECT cit.id, arg_max(trim(context), conv_id) AS text FROM ctx JOIN cit ON cit.uri = replace(citing_uri, '/paper/', '/citation/') || '/' || citing_idx
WHERE regexp_matches(context, '[^ \\t\\n\\r\\f\\v]') GROUP BY 1""")
def derived_key_join(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "conversations")
    citations = c.select(F.concat(F.lit("u:/citation/c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("uri"), (F.col("conv_id") * 100 + F.col("turn")).alias("id")).distinct()
    return records.citation_texts(_contexts(spark, d), citations, "conv_id")


@query("SELECT user_id, event_type, arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id FROM events GROUP BY 1, 2")
def last_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").withColumn("pos", F.struct("ts", F.col("event_id").alias("tie")))
    return records.last_wins(e, ["user_id", "event_type"], "event_id", "pos")


@query("SELECT p_brand AS uri, arg_min(p_name, lpad((1000 - length(p_name))::VARCHAR, 6, '0') || p_name) AS title FROM part WHERE p_type <> 'de' GROUP BY 1")
def longest_title(spark: SparkSession, d: str) -> DataFrame:
    titles = _table(spark, d, "part").select(F.col("p_brand").alias("uri"), F.col("p_name").alias("title"), F.when(F.col("p_type") == "de", F.lit("de")).alias("lang"))
    return retrieval.pick_titles(titles)


_SQL_SPLIT = """g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42:' || o_custkey), o_custkey) - 1 AS r, count(*) OVER () AS n FROM g),
s AS (SELECT o_custkey, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)"""


@query(f"WITH {_SQL_SPLIT} SELECT * FROM s")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return records.group_split(_table(spark, d, "orders"), "o_custkey")


@query(f"WITH {_SQL_SPLIT} SELECT split, CAST(count(*) AS BIGINT) AS n_records, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_groups FROM orders JOIN s USING (o_custkey) GROUP BY split")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders").select("o_custkey")
    joined = orders.join(records.group_split(orders, "o_custkey"), "o_custkey")
    return joined.groupBy("split").agg(F.count("*").alias("n_records"), F.count_distinct("o_custkey").alias("n_groups"))


_SQL_MEMBERS = "m AS (SELECT conv_id * 1000 + turn AS member, conv_id FROM conversations)"
_SQL_BATCHES = f"""{_SQL_MEMBERS}, ro AS (SELECT member, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY md5('42:0:' || member), member) AS round FROM m),
ba AS (SELECT member, conv_id, CAST(round AS INTEGER) AS round, (row_number() OVER (PARTITION BY round ORDER BY md5('42:0:' || conv_id), conv_id) - 1) // 32 AS batch FROM ro)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("member"), "conv_id")


@query(f"WITH {_SQL_BATCHES} SELECT member, conv_id, round, CAST(batch AS BIGINT) AS batch FROM ba")
def anti_affinity_batches(spark: SparkSession, d: str) -> DataFrame:
    return records.anti_affinity_batches(_members(spark, d), "conv_id", "member", 32)


@query(f"WITH {_SQL_BATCHES} SELECT member, conv_id, round, CAST(batch AS BIGINT) AS batch FROM ba QUALIFY count(*) OVER (PARTITION BY round, batch) = 32")
def full_batches(spark: SparkSession, d: str) -> DataFrame:
    return records.full_batches(records.anti_affinity_batches(_members(spark, d), "conv_id", "member", 32), 32)


@query(f"WITH {_SQL_BATCHES} SELECT CAST(count(DISTINCT (round, batch)) AS BIGINT) AS n_batches, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM m GROUP BY conv_id)) AS BIGINT) AS largest_group FROM ba")
def largest_group(spark: SparkSession, d: str) -> DataFrame:
    members = _members(spark, d)
    largest = members.groupBy("conv_id").count().agg(F.max("count").alias("largest_group"))
    batched = records.anti_affinity_batches(members, "conv_id", "member", 32)
    return batched.select("round", "batch").distinct().agg(F.count("*").alias("n_batches")).join(largest)


@query(f"WITH {_SQL_MEMBERS} SELECT member, CAST(row_number() OVER (ORDER BY member) - 1 AS BIGINT) AS pos, CAST((row_number() OVER (ORDER BY member) - 1) // 32 AS BIGINT) AS batch FROM m")
def sequential_batches(spark: SparkSession, d: str) -> DataFrame:
    return records.sequential_batches(_members(spark, d).select("member"), ["member"], 32)


@query("""WITH t AS (SELECT doc_id, doc_id // 16 AS batch, list_slice(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w)), 1, 256) AS tokens FROM documents),
p AS (SELECT doc_id, batch, tokens, max(len(tokens)) OVER (PARTITION BY batch) AS longest FROM t)
SELECT doc_id, CAST(unnest(range(longest)) AS INTEGER) AS pos, CAST(coalesce(unnest(list_resize(tokens, longest, 0)), 0) AS INTEGER) AS input_id,
  CAST(unnest(list_transform(range(longest), lambda i: CASE WHEN i < len(tokens) THEN 1 ELSE 0 END)) AS INTEGER) AS mask FROM p""")
def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    lengths = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.length(w))
    tokens = docs.select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), F.slice(lengths, 1, 256).alias("tokens"))
    padded = records.pad(tokens, "batch", "tokens").select("doc_id", F.posexplode(F.arrays_zip("input_ids", "attention_mask")).alias("pos", "x"))
    return padded.select("doc_id", "pos", F.col("x.input_ids").alias("input_id"), F.col("x.attention_mask").alias("mask"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped, substring(string_split(text, chr(10))[1], 1, 80) AS line,
  replace('u:/paper/' || doc_id, '/paper/', '/citation/') || '/' || (doc_id % 7) AS citation FROM documents""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    uri = F.concat(F.lit("u:/paper/"), F.col("doc_id").cast("string"))
    return _table(spark, d, "documents").select(
        "doc_id", F.length(text.strip(F.col("text"))).cast("long").alias("stripped"), text.first_line(F.col("text"), 80).alias("line"), text.citation_key(uri, F.col("doc_id") % 7).alias("citation")
    )


# --- loss and history ------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT vec_id AS id, {_SQL_UNIT.format(v='embedding')} AS u FROM embeddings),
b AS (SELECT a.id // 32 AS batch_id, a.id AS row, a.u AS c, p.u AS p FROM e a JOIN e p ON p.id = a.id + 1),
l AS (SELECT x.batch_id, x.row AS i, y.row AS j, list_dot_product(x.c, y.p) / 0.07 AS l FROM b x JOIN b y USING (batch_id)),
r AS (SELECT batch_id, i, ln(sum(exp(l))) - max(CASE WHEN i = j THEN l END) AS ce FROM l GROUP BY 1, 2),
k AS (SELECT batch_id, j, ln(sum(exp(l))) - max(CASE WHEN i = j THEN l END) AS ce FROM l GROUP BY 1, 2)
SELECT batch_id, round((x + y) / 2, 6) AS loss FROM (SELECT batch_id, avg(ce) AS x FROM r GROUP BY 1) JOIN (SELECT batch_id, avg(ce) AS y FROM k GROUP BY 1) USING (batch_id)""")
def infonce_loss(spark: SparkSession, d: str) -> DataFrame:
    unit = _features(spark, d).select("id", vectors.l2_normalise(F.col("vec")).alias("u"))
    paper = unit.select((F.col("id") - 1).alias("id"), F.col("u").alias("paper"))
    batch = unit.join(paper, "id").select(F.floor(F.col("id") / 32).alias("batch_id"), F.col("id").alias("row"), F.col("u").alias("context"), "paper")
    return metrics.infonce(batch).withColumn("loss", F.round("loss", 6))


_SQL_EPOCHS = "h AS (SELECT CAST(date_diff('day', min(day) OVER (), day) AS INTEGER) AS epoch, mrr FROM (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS mrr FROM events GROUP BY 1))"


def _history(spark: SparkSession, d: str) -> DataFrame:
    daily = _table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("mrr"))
    first = daily.agg(F.min("day").alias("first"))
    return daily.join(first).select(F.date_diff("day", "first").alias("epoch"), "mrr")


@query(f"""WITH {_SQL_EPOCHS}, a AS (SELECT *, mrr > coalesce(max(mrr) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS improved FROM h),
b AS (SELECT *, max(mrr) OVER w AS best, max(CASE WHEN improved THEN epoch END) OVER w AS best_at FROM a WINDOW w AS (ORDER BY epoch ROWS UNBOUNDED PRECEDING))
SELECT epoch, mrr, improved, best, best_at, epoch - best_at AS waited, bool_or(epoch - best_at >= 3) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stopped FROM b""")
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    return metrics.early_stopping(_history(spark, d), "epoch", "mrr", 3)


@query("SELECT event_id, value FROM events WHERE value > 0 AND isfinite(1.0::DOUBLE / (CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE value END))")
def nonfinite_filter(spark: SparkSession, d: str) -> DataFrame:
    spoilt = F.when(F.col("event_type") == "view", F.lit(float("inf"))).otherwise(F.lit(1.0) / F.col("value"))
    return _table(spark, d, "events").where("value > 0").withColumn("x", spoilt).where(metrics.finite("x")).select("event_id", "value")


@query("SELECT round(sum(CASE WHEN event_type = 'view' THEN 0 ELSE value END) / greatest(count(*), 1), 6) AS mean_loss FROM events")
def mean_loss(spark: SparkSession, d: str) -> DataFrame:
    loss = F.when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(F.col("value"))
    return metrics.mean_loss(_table(spark, d, "events").select(loss.alias("loss"))).select(F.round("mean_loss", 6).alias("mean_loss"))


# --- sources ---------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A folder that the executors see too: the shared one where a cluster names it."""
    from quillmesh.plans.session import scratch

    return scratch(spark)


_SQL_INDEX = f"""{_SQL_TRIPLES}, uris AS (SELECT s AS uri FROM t WHERE p = 'cites' UNION SELECT o FROM t WHERE p = 'cites'),
cits AS (SELECT DISTINCT s AS uri FROM t WHERE p IN ('hasCited', 'hasCiting')),
ids AS (SELECT 'paper' AS kind, uri, CAST(row_number() OVER (ORDER BY uri) - 1 AS INTEGER) AS id FROM uris
  UNION ALL SELECT 'citation', uri, CAST(row_number() OVER (ORDER BY uri) - 1 AS INTEGER) FROM cits)"""


@query(f"WITH {_SQL_INDEX} SELECT * FROM ids")
def json_sources(spark: SparkSession, d: str) -> DataFrame:
    """The node index written as JSON and read again."""
    path = f"{_folder(spark)}/node_index"
    json_maps.write_node_index(graph.node_index(_triples(spark, d), VOCABULARY), path)
    return json_maps.read_node_index(spark, path)


@query(f"WITH {_SQL_INDEX} SELECT id, uri FROM ids WHERE kind = 'paper'")
def uri_list_source(spark: SparkSession, d: str) -> DataFrame:
    """The papers' URIs written as a JSON list and read again."""
    path = f"{_folder(spark)}/uris"
    json_maps.write_uri_list(graph.dense_ids(graph.paper_nodes(_triples(spark, d), VOCABULARY), ["uri"]), path)
    return json_maps.read_uri_list(spark, path)


@query("SELECT 'u:/paper/p' || l_partkey AS uri, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def counts_source(spark: SparkSession, d: str) -> DataFrame:
    """Contexts per paper written as a JSON object and read again."""
    path = f"{_folder(spark)}/counts"
    uri = F.concat(F.lit("u:/paper/p"), F.col("l_partkey").cast("string")).alias("uri")
    json_maps.write_counts(_table(spark, d, "lineitem").groupBy(uri).agg(F.count("*").alias("n")), path)
    return json_maps.read_counts(spark, path)


@query("SELECT 'u:/paper/' || doc_id AS uri, text FROM documents")
def text_map_source(spark: SparkSession, d: str) -> DataFrame:
    """Texts as JSON objects of uri and text, a file for each part of the table, read again."""
    path = f"{_folder(spark)}/texts"
    entry = F.map_from_arrays(F.array(F.concat(F.lit("u:/paper/"), F.col("doc_id").cast("string"))), F.array("text"))
    _table(spark, d, "documents").select(F.to_json(entry).alias("value")).write.mode("overwrite").text(path)
    return json_maps.read_text_lines(spark, path)


@query(f"WITH {_SQL_CONTEXTS} SELECT context, cited_uri, citing_uri, citing_idx, citation_type, CAST(context_group_id AS BIGINT) AS context_group_id FROM ctx")
def contexts_source(spark: SparkSession, d: str) -> DataFrame:
    """Citation records written as JSON and read again; null fields are missing keys."""
    path = f"{_folder(spark)}/contexts"
    json_maps.write_records(_contexts(spark, d).select("context", "cited_uri", "citing_uri", "citing_idx", "citation_type", "context_group_id"), path)
    return json_maps.read_context_lines(spark, path)


@query(f"WITH {_SQL_TRIPLES} SELECT s, 'u:cites' AS p, o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS dtype FROM t WHERE p = 'cites'")
def turtle_source(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers' citations written as Turtle and read again."""
    path = f"{_folder(spark)}/graph"
    lines = F.concat(F.lit("<"), F.col("s"), F.lit("> <u:cites> <"), F.col("o"), F.lit("> ."))
    _triples(spark, d).where("p = 'cites'").select(lines.alias("value")).write.mode("overwrite").text(path)
    return turtle.read_turtle(spark, f"{path}/*.txt")


@query("SELECT p_partkey AS id, 'u:/paper/' || p_partkey AS uri FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]'))")
def missing_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = _table(spark, d, "documents").select(F.concat(F.lit("u:/paper/"), F.col("doc_id").cast("string")).alias("uri"), "text")
    return propagate.missing_texts(_papers(spark, d), texts)


@query("SELECT 'u:/s' || l_suppkey AS uri, trim(p_name) AS text FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey")
def two_hop_passages(spark: SparkSession, d: str) -> DataFrame:
    """Supplier -> part -> its name, as paper -> citation node -> passage."""
    lines = _table(spark, d, "lineitem").select(F.concat(F.lit("u:/s"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("o")).distinct()
    names = _table(spark, d, "part").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("s"), F.col("p_name").alias("o"))
    triples = lines.select("s", F.lit("hasCitationContext").alias("p"), "o").unionAll(names.select("s", F.lit("hasContext").alias("p"), "o"))
    return graph.passages(triples, VOCABULARY)


@query(f"WITH {_SQL_TRIPLES} SELECT s, o FROM t WHERE p = 'hasCited' AND s IN (SELECT 'u:/citation/o' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def subject_bound_match(spark: SparkSession, d: str) -> DataFrame:
    subjects = _table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("u:/citation/o"), F.col("o_orderkey").cast("string")).alias("s"))
    return graph.match_subjects(_triples(spark, d), subjects, "hasCited")


# --- metapaths, results and datasets ----------------------------------------------------------


@query(f"""WITH {_SQL_VALUES}, sp AS (SELECT l_suppkey AS src, l_partkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2),
ps AS (SELECT dst AS src, src AS dst, w FROM sp), dims AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS dim),
one AS (SELECT sp.src, dim, sum(w * x) / greatest((SELECT sum(w) FROM sp z WHERE z.src = sp.src), 1e-9) AS x FROM sp JOIN vals ON dst = vals.id GROUP BY 1, 2),
two AS (SELECT ps.src, dim, sum(w * x) AS x FROM ps JOIN one ON ps.dst = one.src GROUP BY 1, 2), deg AS (SELECT src, greatest(sum(w), 1e-9) AS degree FROM ps GROUP BY 1)
SELECT deg.src AS id, dims.dim, round(coalesce(x, 0) / degree, 6) + 0.0 AS value FROM deg CROSS JOIN dims LEFT JOIN two ON two.src = deg.src AND two.dim = dims.dim""")
def metapath_two_hops(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the mean over their suppliers of the mean over those suppliers' parts: a chain of two steps, as in PPP."""
    own = graph.coalesce_edges(_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(1.0).alias("w")))
    return vectors.explode_vector(propagate.metapath([graph.transpose(own), own], _features(spark, d), WIDTH), ["id"])


@query(f"""WITH a AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.id, CAST(unnest(range(len(a.v))) AS INTEGER) AS dim, round(unnest(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] + b.v[i] + c.v[i]) / 3)), 6) + 0.0 AS value
FROM a JOIN a b ON b.id = a.id + 1 JOIN a c ON c.id = a.id + 2""")
def mean_over_metapaths(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    keyed = lambda k: f.select((F.col("id") - k).alias("id"), F.col("vec").alias(f"v{k}"))
    joined = f.join(keyed(1), "id").join(keyed(2), "id")
    return vectors.explode_vector(joined.select("id", vectors.mean_of(F.col("vec"), F.col("v1"), F.col("v2")).alias("vec")), ["id"])


@query(f"""WITH {_SQL_TOP} SELECT query_id, rank, round(score, 4) AS score, paper_id, CASE WHEN p_partkey IS NULL THEN 'id:' || paper_id ELSE 'u:/paper/' || p_partkey END AS uri
FROM top LEFT JOIN part ON p_partkey = paper_id AND p_size > 10""")
def topk_with_uri(spark: SparkSession, d: str) -> DataFrame:
    known = _table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("u:/paper/"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_partkey").alias("id"))
    found = retrieval.top_k(_queries(spark, d), _candidates(spark, d), 10).withColumn("score", F.round("score", 4))
    return retrieval.with_uri(found, known).select("query_id", "rank", "score", "paper_id", "uri")


@query(f"""WITH {_SQL_CONTEXTS}, g AS (SELECT DISTINCT citing_uri FROM res WHERE valid), r AS (SELECT citing_uri, row_number() OVER (ORDER BY md5('42:' || citing_uri), citing_uri) - 1 AS r, count(*) OVER () AS n FROM g),
s AS (SELECT citing_uri, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)
SELECT trim(context) AS context_text, paper_id AS cited_paper_id, citing_uri, split FROM res JOIN s USING (citing_uri) WHERE valid""")
def datasets(spark: SparkSession, d: str) -> DataFrame:
    """Valid records with the split of their citing paper."""
    return lifecycle.build_datasets(_contexts(spark, d), _papers(spark, d)).select("context_text", "cited_paper_id", "citing_uri", "split")


@query(f"""WITH {_SQL_MEMBERS}, n AS (SELECT greatest(max(c), ceil(sum(c) / 32.0)) AS k FROM (SELECT count(*) AS c FROM m GROUP BY conv_id)),
p AS (SELECT *, row_number() OVER (ORDER BY md5('42:0:' || conv_id), conv_id, md5('42:0:' || member), member) - 1 AS pos FROM m)
SELECT member, conv_id, CAST(pos % k AS BIGINT) AS batch FROM p CROSS JOIN n""")
def fewest_batches(spark: SparkSession, d: str) -> DataFrame:
    return records.fewest_batches(_members(spark, d), "conv_id", "member", 32)


@query(f"WITH {_SQL_BATCHES} SELECT member, conv_id, round, CAST(batch AS BIGINT) AS batch FROM ba".replace("42:0:", "42:3:"))
def batches_of_an_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The batches of epoch 3: another order than that of epoch 0."""
    return records.anti_affinity_batches(_members(spark, d), "conv_id", "member", 32, epoch=3)


# --- encoders and towers ------------------------------------------------------------------------

_SQL_TOKENS = """words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
tok AS (SELECT doc_id, list_transform(w, lambda x: CAST(('0x' || substring(md5(x), 1, 8))::BIGINT % 30000 + 1 AS INTEGER)) AS ids FROM words)"""
_SQL_BAG = f"""{_SQL_TOKENS}, each AS (SELECT doc_id, unnest(ids) AS i FROM tok),
summed AS (SELECT doc_id, i % 64 AS dim, sum(CASE WHEN (i // 64) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM each GROUP BY 1, 2),
norms AS (SELECT doc_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM summed GROUP BY 1),
bag AS (SELECT doc_id AS id, dim, x / n AS x FROM summed JOIN norms USING (doc_id))"""


def _values(name: str, matrix) -> str:
    """A matrix of weights as a table (i, o, w) of literal rows; a vector has one row."""
    rows = matrix.reshape(-1, matrix.shape[-1])
    return f"{name}(i, o, w) AS (VALUES " + ", ".join(f"({i}, {o}, {float(w)!r}::DOUBLE)" for i, row in enumerate(rows) for o, w in enumerate(row)) + ")"


def _sql_affine(rows: str, w: str, b: str, keys: str) -> str:
    """(keys, dim, x) of rows (keys, dim, x) times a matrix plus a vector; rows may leave zeros out, the keys come from ``keys``."""
    on = " AND ".join(f"k.{c} = r.{c}" for c in keys.split(", "))
    own = ", ".join(f"k.{c}" for c in keys.split(", "))
    return f"""SELECT {own}, b.o AS dim, any_value(b.w) + coalesce(sum(r.x * m.w), 0) AS x FROM (SELECT DISTINCT {keys} FROM keys_{rows}) k CROSS JOIN {b} b
  LEFT JOIN {rows} r ON {on} LEFT JOIN {w} m ON m.i = r.dim AND m.o = b.o GROUP BY {own}, b.o"""


CONTEXT_TOWER = ContextTower(WIDTH, 16).initialise()
PAPER_TOWER = PaperTower(["P", "PCP"], WIDTH, 32, 16, act="leaky_relu").initialise()
PAPER_TOWER.weights["gamma"][:] = 0.5  # a fresh tower's attention adds nothing

_CW, _PW = CONTEXT_TOWER.weights, PAPER_TOWER.weights
_SQL_CONTEXT_TOWER = f"""WITH {_SQL_BAG}, {_values('pw', _CW['proj.w'])}, {_values('pb', _CW['proj.b'])}, keys_bag AS (SELECT doc_id AS id FROM documents),
lin AS ({_sql_affine('bag', 'pw', 'pb', 'id')}),
cen AS (SELECT id, dim, x - avg(x) OVER (PARTITION BY id) AS x FROM lin), nor AS (SELECT id, dim, x / sqrt(avg(x * x) OVER (PARTITION BY id) + 1e-5) AS x FROM cen)
SELECT id AS doc_id, CAST(dim AS INTEGER) AS dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-12), 6) + 0.0 AS value FROM nor"""

_SQL_PAPER_TOWER = f"""WITH {_SQL_EDGES}, {_SQL_VALUES}, deg AS (SELECT src, sum(w) AS d FROM co GROUP BY 1), {_SQL_COCITED},
pcp AS (SELECT co.src AS id, dim, sum(w * x) / any_value(d) AS x FROM co JOIN vals ON vals.id = co.dst JOIN deg ON deg.src = co.src WHERE co.src IN (SELECT vec_id FROM embeddings) GROUP BY 1, 2),
f AS (SELECT id, 0 AS m, dim, x FROM vals UNION ALL SELECT id, 1, dim, x FROM pcp), keys_f AS (SELECT vec_id AS id, m FROM embeddings CROSS JOIN (VALUES (0), (1)) t(m)),
{', '.join(_values(f'{n[0]}w', _PW[f'{n}.w']) + ', ' + _values(f'{n[0]}b', _PW[f'{n}.b']) for n in ('query', 'key', 'value'))},
{_values('cw', _PW['concat.w'])}, {_values('cb', _PW['concat.b'])}, {_values('rw', _PW['residual.w'])}, {_values('hw', _PW['head.w'])}, {_values('hb', _PW['head.b'])},
q AS ({_sql_affine('f', 'qw', 'qb', 'id, m')}), k AS ({_sql_affine('f', 'kw', 'kb', 'id, m')}), v AS ({_sql_affine('f', 'vw', 'vb', 'id, m')}),
raw AS (SELECT q.id, q.m, k.m AS n, sum(q.x * k.x) / sqrt(64) AS s FROM q JOIN k ON k.id = q.id AND k.dim = q.dim GROUP BY 1, 2, 3),
act AS (SELECT id, m, n, exp(CASE WHEN s > 0 THEN s ELSE 0.2 * s END) AS e FROM raw), att AS (SELECT id, m, n, e / sum(e) OVER (PARTITION BY id, m) AS a FROM act),
mix AS (SELECT att.id, att.m, v.dim, 0.5 * sum(a * v.x) AS x FROM att JOIN v ON v.id = att.id AND v.m = att.n GROUP BY 1, 2, 3),
flat AS (SELECT mix.id, mix.m * 64 + mix.dim AS dim, mix.x + coalesce(f.x, 0) AS x FROM mix LEFT JOIN f ON f.id = mix.id AND f.m = mix.m AND f.dim = mix.dim),
keys_flat AS (SELECT vec_id AS id FROM embeddings), fused AS ({_sql_affine('flat', 'cw', 'cb', 'id')}),
plain AS (SELECT id, dim, sum(x) / 2 AS x FROM f GROUP BY 1, 2), skip AS (SELECT id, o AS dim, sum(x * w) AS x FROM plain JOIN rw ON rw.i = plain.dim GROUP BY 1, 2),
both_ways AS (SELECT fused.id, fused.dim, fused.x + coalesce(skip.x, 0) AS x FROM fused LEFT JOIN skip ON skip.id = fused.id AND skip.dim = fused.dim), keys_both_ways AS (SELECT id FROM keys_flat),
head AS ({_sql_affine('both_ways', 'hw', 'hb', 'id')})
SELECT id, CAST(dim AS INTEGER) AS dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-12), 6) + 0.0 AS value FROM head""".replace(f"deg AS (SELECT src, sum(w) AS d FROM co GROUP BY 1), {_SQL_COCITED}", f"{_SQL_COCITED}, deg AS (SELECT src, sum(w) AS d FROM co GROUP BY 1)")


@query(f"WITH {_SQL_TOKENS} SELECT doc_id, CAST(unnest(range(least(len(ids), 256))) AS INTEGER) AS pos, unnest(ids[1:256]) AS token FROM tok")
def tokenised(spark: SparkSession, d: str) -> DataFrame:
    return tokenise(_table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.posexplode("tokens").alias("pos", "token"))


@query(f"WITH {_SQL_BAG}, dims AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS dim) SELECT doc_id, dims.dim, round(coalesce(x, 0), 6) + 0.0 AS value FROM documents CROSS JOIN dims LEFT JOIN bag ON bag.id = doc_id AND bag.dim = dims.dim")
def hash_encoder(spark: SparkSession, d: str) -> DataFrame:
    return vectors.explode_vector(encode(_table(spark, d, "documents"), "doc_id", "text"), ["doc_id"])


@query(_SQL_PAPER_TOWER)
def paper_tower_forward(spark: SparkSession, d: str) -> DataFrame:
    p = _features(spark, d)
    parts = p.select("id")
    pcp = propagate.assemble(parts, propagate.metapath_pcp(_cited(spark, d), p, WIDTH), WIDTH)
    made = embed(p.withColumnRenamed("vec", "P").join(pcp.withColumnRenamed("vec", "PCP"), "id"), PAPER_TOWER, "id", PAPER_TOWER.feat_keys)
    return vectors.explode_vector(made, ["id"], "emb")


@query(_SQL_CONTEXT_TOWER)
def context_tower_forward(spark: SparkSession, d: str) -> DataFrame:
    made = embed(encode(_table(spark, d, "documents"), "doc_id", "text"), CONTEXT_TOWER, "doc_id", ["vec"])
    return vectors.explode_vector(made, ["doc_id"], "emb")
