"""Citation context records: validity, joins to nodes, splits and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import citation_key, has_text, strip
from quillmesh.operators.graph import dense_ids

#: Hex digits of the hash that tell the shares of a round: 4,096 of them.
SHARE_DIGITS = 3


def valid(papers: str = "paper_id") -> Column:
    """Non-blank context, a citation type, a group (0 counts) and a known cited paper."""
    kind = F.coalesce(F.col("citation_type") != "", F.lit(False))
    return has_text(F.col("context")) & kind & F.col("context_group_id").isNotNull() & F.col(papers).isNotNull()


def resolve_records(contexts: DataFrame, papers: DataFrame) -> DataFrame:
    """Contexts with the cited paper's id (null if unknown) and a ``valid`` flag."""
    known = papers.select(F.col("uri").alias("cited_uri"), F.col("id").alias("paper_id"))
    return contexts.join(known, "cited_uri", "left").withColumn("valid", valid())


def citation_records(contexts: DataFrame, papers: DataFrame) -> DataFrame:
    """The valid records with stripped text."""
    text = strip(F.col("context")).alias("context_text")
    citing = F.coalesce("citing_uri", F.lit("")).alias("citing_uri")
    return resolve_records(contexts, papers).where("valid").select(text, F.col("paper_id").alias("cited_paper_id"), "cited_uri", citing, "citation_type", "context_group_id")


def record_counts(contexts: DataFrame, papers: DataFrame) -> DataFrame:
    """One row: raw, kept and skipped."""
    return resolve_records(contexts, papers).agg(F.count("*").alias("raw"), F.count_if("valid").alias("kept"), F.count_if(~F.col("valid")).alias("skipped"))


def citation_texts(contexts: DataFrame, citations: DataFrame, position: str) -> DataFrame:
    """(id, text) of citation nodes by their derived key; of several texts the last in ``position``."""
    uri = citation_key(strip(F.col("citing_uri")), F.col("citing_idx"))
    usable = contexts.where(has_text(F.col("citing_uri")) & F.col("citing_idx").isNotNull() & has_text(F.col("context")))
    keyed = usable.select(uri.alias("uri"), strip(F.col("context")).alias("text"), position)
    return last_wins(keyed.join(citations.select("uri", "id"), "uri"), ["id"], "text", position)


def last_wins(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Per key the value of the row that comes last."""
    return df.groupBy(*keys).agg(F.max_by(value, position).alias(value))


def group_split(df: DataFrame, group: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(group, split): groups in the order of a seeded hash, cut at whole numbers of groups."""
    groups = df.select(group).distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))))
    ranked = dense_ids(groups, ["h", group], "r")
    n = F.lit(ranked.count()).cast("double")
    cut = F.floor(n * F.lit(train)), F.floor(n * F.lit(val))
    split = F.when(F.col("r") < cut[0], "train").when(F.col("r") < cut[0] + cut[1], "val").otherwise("test")
    return ranked.select(group, split.alias("split"))


def _shuffled(seed: int, epoch: int):
    """Hex digest that orders values of a column at random, anew for every seed and epoch."""
    return lambda c: F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(c).cast("string")))


def anti_affinity_batches(df: DataFrame, group: str, member: str, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(member, group, round, batch): no batch holds two members of a group.

    Members of a group take different rounds; a round's members are cut into batches.  Everything
    is ordered by a seeded hash.  Each round may leave one short batch.  The members of a round are
    numbered within shares of the hash, so that a round of all groups is many tasks.
    """
    of = _shuffled(seed, epoch)
    rounds = df.select(member, group).withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(of(member), member)))
    shared = rounds.withColumn("share", F.substring(of(group), 1, SHARE_DIGITS))
    counts = shared.groupBy("round", "share").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("round").orderBy("share")) - F.col("n")
    within = F.row_number().over(Window.partitionBy("round", "share").orderBy(of(group), group)) - 1
    placed = shared.withColumn("within", within).join(counts.select("round", "share", before.alias("before")), ["round", "share"])
    return placed.select(member, group, "round", F.floor((F.col("before") + F.col("within")) / F.lit(size)).cast("long").alias("batch"))


def full_batches(batched: DataFrame, size: int) -> DataFrame:
    """Without the batches that are short."""
    own = Window.partitionBy("round", "batch")
    return batched.withColumn("n", F.count("*").over(own)).where(F.col("n") == size).drop("n")


def sequential_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Batches of consecutive rows in a fixed order."""
    return dense_ids(df, order, "pos").withColumn("batch", F.floor(F.col("pos") / F.lit(size)).cast("long"))


def fewest_batches(df: DataFrame, group: str, member: str, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(member, group, batch): no batch holds two members of a group, none is over ``size``, and there are as few as can be.

    That is K batches, the larger of the largest group and of rows / size.  The members are put in
    an order where a group's stand together, and dealt out in turn: K neighbours meet K batches.
    """
    of = _shuffled(seed, epoch)
    ordered = dense_ids(df.select(member, group).withColumns({"hg": of(group), "hm": of(member)}), ["hg", group, "hm", member], "pos")
    rows, largest = ordered.groupBy(group).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    number = max(largest, -(-rows // size), 1)
    return ordered.select(member, group, (F.col("pos") % number).alias("batch"))


def pad(df: DataFrame, batch: str, ids: str) -> DataFrame:
    """Token ids and attention mask, filled with 0 up to the longest row of the batch."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    gap = F.array_repeat(F.lit(0), (longest - F.size(ids)).cast("int"))
    mask = F.concat(F.transform(ids, lambda x: F.lit(1)), gap)
    return df.withColumns({"input_ids": F.concat(ids, gap), "attention_mask": mask})
