"""Turtle documents as a set of triples: a small parser and two ways to read with it.

``read_turtle`` goes through Spark's binary file reader, so any store Spark knows will do.  The
``turtle`` data source offers the same rows to ``spark.read.format("turtle")``.  A document isn't
splittable: one file is one task; convert large graphs to Parquet once.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmesh.plans.session import ship

SCHEMA = "s string, p string, o string, o_kind string, lang string, dtype string"
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_XSD = "http://www.w3.org/2001/XMLSchema#"

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)
      | <(?P<iri>[^<>"{}|^`\x00-\x20]*)>
      | (?P<long>\"{3}(?:[^"\\]|\\.|"{1,2}(?!"))*\"{3}|'{3}(?:[^'\\]|\\.|'{1,2}(?!'))*'{3})
      | (?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
      | (?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=[\s<]))
      | @(?P<lang>[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
      | \^\^(?P<typed>)
      | (?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![\w:]))
      | _:(?P<blank>[\w·](?:[\w·.-]*[\w·-])?)
      | (?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:[\w:%\\](?:(?:[\w.:%\\/#-]|\\.)*[\w:%/#-])?)?)
      | (?P<word>true|false|a)(?![\w:])
      | (?P<mark>[;,.\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_SIMPLE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


class Triple(NamedTuple):
    s: str
    p: str
    o: str
    o_kind: str  # iri, blank or literal
    lang: str | None
    dtype: str | None


class TurtleError(ValueError):
    """The document isn't Turtle; the message tells the position."""


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SIMPLE.get(m[3], m[3]), text) if "\\" in text else text


class _Parser:
    def __init__(self, text: str, scope: str) -> None:
        self.tokens = self._scan(text)
        self.kind, self.value, self.at = "", "", 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.scope, self.made = scope, 0
        self.out: list[Triple] = []
        self.step()

    @staticmethod
    def _scan(text: str) -> Iterator[tuple[str, str, int]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None or m.end() == at:
                raise TurtleError(f"unexpected text at {at}: {text[at : at + 30]!r}")
            if m.lastgroup != "space":
                yield m.lastgroup, m[m.lastgroup], at
            at = m.end()
        yield "end", "", at

    def step(self) -> None:
        self.kind, self.value, self.at = next(self.tokens, ("end", "", self.at))

    def expect(self, mark: str) -> None:
        if (self.kind, self.value) != ("mark", mark):
            raise TurtleError(f"{mark!r} expected at {self.at}, found {self.value!r}")
        self.step()

    def is_mark(self, *marks: str) -> bool:
        return self.kind == "mark" and self.value in marks

    def resolve(self, iri: str) -> str:
        iri = _unescape(iri)
        if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", iri) or not self.base:
            return iri
        if iri.startswith("#") or not iri:
            return self.base.partition("#")[0] + iri
        if iri.startswith("/"):
            return "/".join(self.base.split("/")[:3]) + iri
        return self.base.rpartition("/")[0] + "/" + iri

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}g{self.made}"

    def document(self) -> list[Triple]:
        while self.kind != "end":
            if self.kind == "directive":
                self.directive()
            else:
                self.statement()
        return self.out

    def directive(self) -> None:
        word = self.value
        self.step()
        if word.lower().endswith("prefix"):
            name = self.value
            if self.kind != "name" or not name.endswith(":"):
                raise TurtleError(f"a prefix is expected at {self.at}")
            self.step()
            self.prefixes[name[:-1]] = self.resolve(self.iri_token())
        else:
            self.base = self.resolve(self.iri_token())
        if word.startswith("@"):
            self.expect(".")

    def iri_token(self) -> str:
        if self.kind != "iri":
            raise TurtleError(f"an IRI is expected at {self.at}")
        value = self.value
        self.step()
        return value

    def statement(self) -> None:
        bare = self.is_mark("[")
        subject, kind = self.term()[:2]
        if kind == "literal":
            raise TurtleError(f"a literal can't be a subject, before {self.at}")
        if not (bare and self.is_mark(".")):
            self.predicates(subject)
        self.expect(".")

    def predicates(self, subject: str) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                predicate = _RDF + "type"
                self.step()
            else:
                predicate, kind = self.term()[:2]
                if kind != "iri":
                    raise TurtleError(f"a predicate is expected before {self.at}")
            while True:
                self.out.append(Triple(subject, predicate, *self.term()))
                if not self.is_mark(","):
                    break
                self.step()
            while self.is_mark(";"):
                self.step()
                if self.is_mark(".", "]"):
                    return
                if not self.is_mark(";"):
                    break
            else:
                return

    def term(self) -> tuple[str, str, str | None, str | None]:
        kind, value = self.kind, self.value
        if kind == "mark" and value == "[":
            self.step()
            node = self.fresh()
            if not self.is_mark("]"):
                self.predicates(node)
            self.expect("]")
            return node, "blank", None, None
        if kind == "mark" and value == "(":
            node = self.collection()
            return node, "blank" if node.startswith("_:") else "iri", None, None
        self.step()
        if kind == "iri":
            return self.resolve(value), "iri", None, None
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r} before {self.at}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None
        if kind == "blank":
            return f"_:{self.scope}{value}", "blank", None, None
        if kind == "number":
            own = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return value, "literal", None, _XSD + own
        if kind == "word" and value != "a":
            return value, "literal", None, _XSD + "boolean"
        if kind in ("long", "short"):
            edge = 3 if kind == "long" else 1
            text, lang, dtype = _unescape(value[edge:-edge]), None, None
            if self.kind == "lang":
                lang = self.value
                self.step()
            elif self.kind == "typed":
                self.step()
                dtype = self.term()[0]
            return text, "literal", lang, dtype
        raise TurtleError(f"unexpected {value!r} before {self.at}")

    def collection(self) -> str:
        self.step()
        items = []
        while not self.is_mark(")"):
            if self.kind == "end":
                raise TurtleError("a collection isn't closed")
            items.append(self.term())
        self.step()
        rest = _RDF + "nil"
        for item in reversed(items):
            node = self.fresh()
            self.out.append(Triple(node, _RDF + "first", *item))
            self.out.append(Triple(node, _RDF + "rest", rest, "blank" if rest.startswith("_:") else "iri", None, None))
            rest = node
        return rest


def parse_turtle(text: str, scope: str = "") -> list[Triple]:
    """Triples of a document in order, repeats included; ``scope`` keeps blank nodes of files apart."""
    return _Parser(text, scope).document()


def _columns(triples: list[Triple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t[k] for t in triples], pa.string()) for k in range(6)], list(Triple._fields))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The triple set of all documents under ``path`` (a file, folder or glob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scope = os.path.basename(name) + "/"
                yield _columns(parse_turtle(raw.decode("utf-8"), scope))

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA).dropDuplicates()


class TurtleSource(DataSource):
    """``spark.read.format("turtle").load(path)``: one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TurtleReader(self.options["path"])


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path (a URI of any kind that Arrow knows, or a plain path) and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _TurtleReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, path = _file_system(self.path)
        folder, _, pattern = path.rpartition("/") if re.search(r"[*?]", path) else (path, "", "*.ttl")
        if store.get_file_info(path).type == fs.FileType.File:
            return [InputPartition(path)]
        found = store.get_file_info(fs.FileSelector(folder or "."))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and fnmatch.fnmatch(f.base_name, pattern)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _file_system(self.path)[0].open_input_stream(partition.value) as f:
            yield from (tuple(t) for t in parse_turtle(f.read().decode("utf-8"), os.path.basename(partition.value) + "/"))


def register(spark: SparkSession) -> None:
    """Make the ``turtle`` format known to a session."""
    spark.dataSource.register(TurtleSource)
