"""Turtle and JSON documents."""

from __future__ import annotations

import json

import pytest

from quillmesh.operators import graph, retrieval
from quillmesh.sources import json_maps, turtle

DOC = '''@prefix c: <http://purl.org/spar/cito/> . @prefix : <http://x/> .
PREFIX dc: <http://purl.org/dc/terms/>
@base <http://x/> .
:paper\\/a1 c:cites :b2 , <paper/d4> ; c:cites <http://other/x> ; .   # comment
<paper/d4> dc:title "Short"@en, """A long
title""" , 'Titre'@fr ; :n 3 , -1.5 , 2e3 , true ; a :Paper .
_:c1 :has [ :text "say \\"hi\\" \\u00e9" ] .
:l :items ( 1 :two ) .
:t :typed "5"^^<http://www.w3.org/2001/XMLSchema#int> .
'''


def test_grammar():
    got = turtle.parse_turtle(DOC)
    assert ("http://x/paper/a1", "http://purl.org/spar/cito/cites", "http://x/paper/d4") in [t[:3] for t in got]
    assert {(t.o, t.lang) for t in got if t.p.endswith("title")} == {("Short", "en"), ("A long\ntitle", None), ("Titre", "fr")}
    assert {t.o for t in got if t.p == "http://x/n"} == {"3", "-1.5", "2e3", "true"}
    assert any(t.o == 'say "hi" é' for t in got)
    assert sum(t.p.endswith("#first") for t in got) == 2 and sum(t.p.endswith("#rest") for t in got) == 2
    assert [t.dtype for t in got if t.p == "http://x/typed"] == ["http://www.w3.org/2001/XMLSchema#int"]


@pytest.mark.parametrize("bad", ["<a> <b>", "<a> <b> .", 'x:y <b> <c> .', '"lit" <b> <c> .', "<a> <b> ( 1 ."])
def test_errors(bad):
    with pytest.raises(turtle.TurtleError):
        turtle.parse_turtle(bad)


def test_empty_document():
    assert turtle.parse_turtle(" # nothing\n") == []


def test_both_readers_agree_and_repeats_go(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<s> <p> <o> . <s> <p> <o> . <s> <q> 'x'@en .")
    turtle.register(spark)
    one = {tuple(r) for r in turtle.read_turtle(spark, str(tmp_path / "a.ttl")).collect()}
    two = {tuple(r) for r in spark.read.format("turtle").load(str(tmp_path / "a.ttl")).dropDuplicates().collect()}
    assert one == two and len(one) == 2


def test_graph_from_triples(spark):
    v = graph.Vocabulary("p/", "c/", "o#")
    rows = [("p/a", v.cites, "p/d"), ("p/a", v.cites, "x/z"), ("p/b", v.cites, "p/a"), ("p/f", v.is_cited_by, "p/a"), ("c/1", v.has_cited, "p/d"), ("c/0", v.has_citing, "p/a"), ("q/1", v.has_cited, "p/d")]
    rows += [("p/d", v.has_citation_context, "n1"), ("n1", v.has_context, "  says \t"), ("p/d", v.has_citation_context, "n2"), ("n2", v.has_context, "  ")]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    nodes = {(r.kind, r.uri): (r.id, r.is_corpus) for r in graph.node_index(t, v).collect()}
    assert nodes == {
        ("paper", "p/a"): (0, True), ("paper", "p/b"): (1, True), ("paper", "p/d"): (2, False), ("paper", "p/f"): (3, False),
        ("citation", "c/0"): (0, None), ("citation", "c/1"): (1, None),
    }
    papers = graph.dense_ids(graph.paper_nodes(t, v), ["uri"])
    assert {(r.src, r.dst) for r in graph.edges(t, v.cites, papers, papers).collect()} == {(0, 2), (1, 0)}
    assert [tuple(r) for r in graph.passages(t, v).collect()] == [("p/d", "says")]


def test_dense_ids_over_ranges(spark):
    """Ids follow the order over many ranges, whatever the partitions were; ties and an empty table included."""
    df = spark.createDataFrame([(f"u{k:04d}", k % 3) for k in range(2000)][::-1], "uri string, n int").repartition(7)
    assert sorted(map(tuple, graph.dense_ids(df.select("uri"), ["uri"]).collect())) == [(f"u{k:04d}", k) for k in range(2000)]
    tied = graph.dense_ids(df, ["n", "uri"], "at").collect()
    assert [r.at for r in sorted(tied, key=lambda r: (r.n, r.uri))] == list(range(2000))
    assert sorted(r.at for r in graph.dense_ids(df.select("n"), ["n"], "at").collect()) == list(range(2000))
    assert graph.dense_ids(df.limit(0), ["uri"]).count() == 0


def test_json_documents(spark, tmp_path):
    nodes = spark.createDataFrame([("paper", "b", 1), ("paper", "a", 0), ("citation", "z", 0)], "kind string, uri string, id int")
    json_maps.write_node_index(nodes, str(tmp_path / "index"))
    assert {tuple(r) for r in json_maps.read_node_index(spark, str(tmp_path / "index")).collect()} == {tuple(r) for r in nodes.collect()}
    json_maps.write_uri_list(nodes.where("kind = 'paper'"), str(tmp_path / "list"))
    assert [tuple(r) for r in json_maps.read_uri_list(spark, str(tmp_path / "list")).orderBy("id").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "ctx.json").write_text(json.dumps([{"context": "x", "citing_idx": 0}, {"cited_uri": "u"}]))
    got = json_maps.read_contexts(spark, str(tmp_path / "ctx.json")).collect()
    assert [r.context for r in got] == ["x", None] and got[1].context_group_id is None
    assert json_maps.read_text_map(spark, str(tmp_path / "none.json")).count() == 0


def test_titles(spark):
    rows = [("a", "kurz", "de"), ("a", "abc", None), ("a", "abd", "en"), ("b", "langer titel", "de"), ("c", "x", "")]
    got = {r.uri: r.title for r in retrieval.pick_titles(spark.createDataFrame(rows, "uri string, title string, lang string")).collect()}
    assert got == {"a": "abc", "c": "x"}
