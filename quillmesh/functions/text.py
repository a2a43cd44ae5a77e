"""Scalar text functions of the record and metadata operators, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that Unicode calls white space, and the four separators that belong to it elsewhere.
_EDGE = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text, _EDGE, "")


def has_text(text: Column) -> Column:
    """True for text with something besides white space; never null."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def first_line(text: Column, limit: int = 300) -> Column:
    """First line, cut to ``limit`` code points; total on empty text."""
    return F.substring(F.element_at(F.split(text, _LINE_END, 2), 1), 1, limit)


def citation_key(citing_uri: Column, position: Column) -> Column:
    """URI of a citation node: the citing paper's under the citation path, and the ordinal."""
    return F.concat(F.replace(citing_uri, F.lit("/paper/"), F.lit("/citation/")), F.lit("/"), position.cast("string"))


def or_else(text: Column, default: Column) -> Column:
    """``text`` unless it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), default)
