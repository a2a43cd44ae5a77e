"""Nodes and edges of a citation graph from RDF triples: pattern scans, set algebra, dense ids, joins."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.plans.session import stored


@dataclass(frozen=True)
class Vocabulary:
    """Predicates and URI prefixes of a graph.  The defaults are those of public citation ontologies."""

    paper_prefix: str
    citation_prefix: str
    ontology: str = ""
    cites: str = "http://purl.org/spar/cito/cites"
    is_cited_by: str = "http://purl.org/spar/cito/isCitedBy"
    has_citing: str = "http://purl.org/spar/cito/hasCitingEntity"
    has_cited: str = "http://purl.org/spar/cito/hasCitedEntity"
    has_context: str = "http://purl.org/spar/c4o/hasContext"
    title: str = "http://purl.org/dc/terms/title"

    @property
    def has_citation_context(self) -> str:
        return self.ontology + "hasCitationContext"


def match(triples: DataFrame, predicate: str | list[str]) -> DataFrame:
    """Triples of one predicate or several; the filter reaches the scan."""
    return triples.where(F.col("p").isin(predicate) if isinstance(predicate, list) else F.col("p") == predicate)


def distinct_uris(triples: DataFrame, column: str, prefix: str) -> DataFrame:
    """Distinct URIs of one side, of one namespace."""
    return triples.select(F.col(column).alias("uri")).where(F.col("uri").startswith(prefix)).distinct()


def paper_nodes(triples: DataFrame, v: Vocabulary) -> DataFrame:
    """(uri, is_corpus): the citing papers are the corpus, those cited only are external."""
    both = match(triples, [v.cites, v.is_cited_by])
    ends = both.select(F.explode(F.array(F.struct(F.col("s").alias("uri"), (F.col("p") == v.cites).alias("citing")), F.struct(F.col("o").alias("uri"), F.lit(False).alias("citing")))).alias("e"))
    return ends.select("e.*").where(F.col("uri").startswith(v.paper_prefix)).groupBy("uri").agg(F.bool_or("citing").alias("is_corpus"))


def citation_nodes(triples: DataFrame, v: Vocabulary) -> DataFrame:
    return distinct_uris(match(triples, [v.has_citing, v.has_cited]), "s", v.citation_prefix)


def dense_ids(df: DataFrame, order: list[str], out: str = "id", partition: list[str] | None = None) -> DataFrame:
    """Ids 0, 1, ... in the order of columns; per group where ``partition`` is given.

    The rows are sorted over ranges and stored with their place in their range; what stands before
    a range is a sum over the counts of the ranges, one small row each.
    """
    if partition:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))
    place = F.monotonically_increasing_id()  # number of the range in the high bits, place in it in the low 33
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place)
    ranged = stored(ranged, "ranges").withColumn("__range", F.shiftright("__place", 33))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()
    before = [0, *accumulate(r["n"] for r in counts)][: len(counts)]
    offsets = df.sparkSession.createDataFrame([(r["__range"], b) for r, b in zip(counts, before, strict=True)], "__range long, __before long")
    numbered = ranged.join(F.broadcast(offsets), "__range")  # as many rows as the sort had partitions
    return numbered.select(*df.columns, (F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1)).alias(out))


def node_index(triples: DataFrame, v: Vocabulary) -> DataFrame:
    """(kind, uri, is_corpus, id): two sequences of ids, each over sorted URIs."""
    papers = dense_ids(paper_nodes(triples, v), ["uri"]).select(F.lit("paper").alias("kind"), "uri", "is_corpus", "id")
    citations = dense_ids(citation_nodes(triples, v), ["uri"]).select(F.lit("citation").alias("kind"), "uri", F.lit(None).cast("boolean").alias("is_corpus"), "id")
    return papers.unionAll(citations)


def edges(triples: DataFrame, predicate: str, source: DataFrame, target: DataFrame) -> DataFrame:
    """(src, dst, w) of one predicate; both ends must be known nodes (uri, id)."""
    left = source.select(F.col("uri").alias("s"), F.col("id").alias("src"))
    right = target.select(F.col("uri").alias("o"), F.col("id").alias("dst"))
    return coalesce_edges(match(triples, predicate).join(left, "s").join(right, "o").select("src", "dst", F.lit(1.0).alias("w")))


def coalesce_edges(df: DataFrame) -> DataFrame:
    """Repeated (src, dst) summed."""
    return df.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def transpose(df: DataFrame) -> DataFrame:
    return df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def row_degree(df: DataFrame) -> DataFrame:
    return df.groupBy("src").agg(F.sum("w").alias("degree"))


def row_normalise(df: DataFrame, floor: float = 1e-9) -> DataFrame:
    """Weights over their row's sum, which is never taken below ``floor``."""
    total = row_degree(df).select("src", F.greatest("degree", F.lit(floor)).alias("total"))
    return df.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w"))


def cocitation(df: DataFrame) -> DataFrame:
    """How many nodes (src) cite both papers: symmetric (src, dst, w) without a diagonal.

    One triangle is joined and summed, then mirrored, which halves the shuffle.
    """
    left = df.select(F.col("src").alias("c"), F.col("dst").alias("a"), F.col("w").alias("wa"))
    right = df.select(F.col("src").alias("c"), F.col("dst").alias("b"), F.col("w").alias("wb"))
    half = left.join(right, "c").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return half.select(sides.alias("e"), "w").select("e.src", "e.dst", "w")


def match_subjects(triples: DataFrame, subjects: DataFrame, predicate: str) -> DataFrame:
    """(s, o) of one predicate with the subject bound to one of ``subjects`` (column s)."""
    return match(triples, predicate).select("s", "o").join(subjects.select("s").distinct(), "s", "left_semi")


def passages(triples: DataFrame, v: Vocabulary) -> DataFrame:
    """(uri, text) of the passages that cite a paper, two hops away; blank ones are left out."""
    from quillmesh.functions.text import has_text, strip

    hop = match(triples, v.has_citation_context).select(F.col("s").alias("uri"), F.col("o").alias("c"))
    text = match(triples, v.has_context).select(F.col("s").alias("c"), strip(F.col("o")).alias("text"))
    return hop.join(text, "c").where(has_text(F.col("text"))).select("uri", "text")
