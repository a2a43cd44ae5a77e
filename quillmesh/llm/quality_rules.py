"""Quality rules: a threshold table compiled into one Spark projection (native, no user functions).

Every figure is computed inside the row, so the operator never shuffles and a hot source or a
very long document costs only its own length.  Texts whose three-word windows all hash apart have
no repeated one.  In the others one ``long`` per window (hash in the high bits, position in the low
bits) is sorted; the windows that share a hash are then sorted by their words, and equal neighbours
there are the repeats, whatever else shares the hash.

Nulls and edges: null or blank text has no words and fails the base rule; ``doc_id`` may be null
or repeated (rows are independent); other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import BLANKS, words

SYMBOLS = "#*$%&|<>"
#: Punctuation that doesn't belong to a stop word beside it.
EDGE = ".,;:!?\"'()#*$%&|<>"

#: Frequent function words of the four supported languages.
STOP_WORDS = (
    "the of and to in is that it for with on be by as are at this an or was from "
    "le la les de des du un une et est en que qui dans pour pas sur par au avec "
    "der die das und ist den von zu mit dem ein eine nicht auf für im des sich auch "
    "el los las y que en una por con para del se es un lo su como más"
).split()


class Rule(NamedTuple):
    """``figure`` must lie within [low, high]; a null bound is open."""

    name: str
    figure: str
    low: float | None
    high: float | None


#: The production table.  Figures are the columns of :func:`ratios`.
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 18.0),
    Rule("symbol_ratio", "symbol_ratio", None, 0.10),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.50),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.90),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.50),
    Rule("letters", "letter_word_ratio", 0.50, None),
)


#: Start of a word.
_START = r"(?<![^ \t\n\x0B\f\r])"


def _stripped(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


#: Sorted (hash, position) of every window; ``b`` is the number of bits of a position.
_SORTED = "sort_array(transform(h, (x, i) -> shiftleft(x, b) | CAST(i AS bigint)))"
#: Positions whose hash, as far as it was kept, is that of a neighbour.
_SHARED = (
    "array_distinct(flatten(filter(zip_with(slice(s, 1, greatest(size(s) - 1, 0)), slice(s, 2, greatest(size(s) - 1, 0)),"
    " (x, y) -> IF(shiftrightunsigned(x ^ y, b) = 0, array(CAST(x & (shiftleft(1L, b) - 1) AS int), CAST(y & (shiftleft(1L, b) - 1) AS int)), NULL)), x -> x IS NOT NULL)))"
)
#: Those positions in the order of their windows' words.
_BY_WORDS = "sort_array(transform(shared, p -> named_struct('w', array(get(w, p), get(w, p + 1), get(w, p + 2)), 'p', p)))"
#: Positions of windows that equal a neighbour in that order.
_REPEATED = (
    "array_distinct(flatten(filter(zip_with(slice(o, 1, greatest(size(o) - 1, 0)), slice(o, 2, greatest(size(o) - 1, 0)),"
    " (x, y) -> IF(x.w = y.w, array(x.p, y.p), NULL)), x -> x IS NOT NULL)))"
)


def figures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every document: words, characters in words, symbols, repeated lines and windows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        words(F.col(text_col)).alias("w"),
        F.filter(F.split(text, "\n", -1), lambda x: _stripped(x, BLANKS) != "").alias("lines"),
        F.length(_stripped(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_stripped(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    # A word is hashed once, a window from its three words' hashes.
    hashed = base.withColumn("n_words", F.size("w").cast("long")).withColumn("g", F.transform("w", lambda x: F.xxhash64(x)))
    tails = [F.expr(f"slice(g, {k}, greatest(size(g) - 2, 0))") for k in (1, 2, 3)]
    windows = F.transform(F.arrays_zip(*[x.alias(n) for x, n in zip(tails, "abc", strict=True)]), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    hashed = hashed.withColumn("h", windows).drop("g")
    hashed = hashed.withColumn("repeats", F.size(F.array_distinct("h")) < F.size("h")).withColumn("b", F.length(F.bin("n_words")))
    only = lambda e: F.when(F.col("repeats"), F.expr(e))
    found = hashed.withColumn("s", only(_SORTED)).drop("h").withColumn("shared", only(_SHARED)).drop("s").withColumn("o", only(_BY_WORDS)).withColumn("starts", only(_REPEATED))
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(p, p + 1, p + 2)))))
    return found.select(
        "doc_id", "text", "w", "lines", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ratios() -> dict[str, Column]:
    """Figure name to expression over the columns of :func:`figures`."""
    lines = F.size("lines")
    bare = lambda x: F.lower(F.btrim(x, F.lit(EDGE)))
    with_letter = F.regexp_count("text", F.lit(rf"{_START}[^ \t\n\x0B\f\r\p{{L}}]*+\p{{L}}"))
    return {
        "mean_word_length": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("word_chars")),
        # A literal list this long becomes a hash set.
        "stop_word_ratio": _ratio(F.size(F.filter("w", lambda x: bare(x).isin(*dict.fromkeys(STOP_WORDS)))), F.col("n_words")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), lines),
        "bullet_line_ratio": _ratio(F.size(F.filter("lines", lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))), lines),
        "ellipsis_line_ratio": _ratio(F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))), lines),
        "letter_word_ratio": _ratio(with_letter, F.col("n_words")),
    }


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratios, the names of broken rules and the verdict of every document."""
    known = ratios()
    broken = [
        F.when((F.lit(False) if r.low is None else F.col(r.figure) < r.low) | (F.lit(False) if r.high is None else F.col(r.figure) > r.high), F.lit(r.name))
        for r in rules
    ]
    counted = figures(df, id_col, text_col)
    return (
        counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[e.alias(k) for k, e in known.items()])
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("broken", F.array_compact(F.array(*broken)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    )


def oracle_sql() -> str:
    """The base figures and the verdict of the production table in DuckDB SQL over ``documents``."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    stop = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    edge = EDGE.replace("'", "''")
    ratio = {
        "mean_word_length": "word_chars / n", "symbol_ratio": "n_symbols / greatest(word_chars, 1)", "dup_line_ratio": "n_dup_lines / greatest(len(lines), 1)",
        "stop_word_ratio": f"len(list_filter(w, lambda x: lower(trim(x, '{edge}')) IN ({stop}))) / n",
        "bullet_line_ratio": "len(list_filter(lines, lambda x: substring(ltrim(x, ' '), 1, 1) IN ('-', '*', '•'))) / greatest(len(lines), 1)",
        "ellipsis_line_ratio": "len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) / greatest(len(lines), 1)",
        "letter_word_ratio": r"len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) / n",
    }
    broken = " OR ".join([f"({ratio[r.figure]} < {r.low})" for r in RULES if r.low is not None] + [f"({ratio[r.figure]} > {r.high})" for r in RULES if r.high is not None])
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: trim(x, {blanks}) <> '') AS lines FROM d
), g AS (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM a
), u AS (
  SELECT r, p, x, lead(x, 1) OVER f AS y, lead(x, 2) OVER f AS z FROM g WINDOW f AS (PARTITION BY r ORDER BY p)
), t AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM u WHERE z IS NOT NULL
), v AS (
  SELECT r, count(DISTINCT p + k) AS n_repeat_words FROM t CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r
), f AS (
  SELECT doc_id, w, lines, len(w) AS n_words, greatest(len(w), 1)::DOUBLE AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM a LEFT JOIN v USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT ({broken}) AS kept FROM b
"""
