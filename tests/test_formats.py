"""RDF syntaxes: what is written is read back, escapes and graphs are kept, bad lines are told."""

import pytest

from claimloom.config import RDF, XSD
from claimloom.schemas import TRIPLES
from claimloom.sources import formats, rdf

ROWS = [
    ("http://x/a", "iri", "http://x/p", "http://x/b?q=1&r=<2>".replace("<2>", "2"), "iri", None, None),
    ("http://x/a", "iri", "http://x/l", 'q"uo\\te <&> é 😀\nline\ttab', "literal", None, "de"),
    ("http://x/a", "iri", "http://x/n", "3", "literal", XSD + "integer", None),
    ("_:k", "bnode", "http://x/p", "_:m", "bnode", None, None),
    ("_:k", "bnode", RDF + "type", "http://x/T", "iri", None, None),
    ("http://x/a", "iri", "http://x/empty", "", "literal", None, None),
]
EDGE = {(s[:2], p, o[:2] if k == "bnode" else o, k, d, lang) for s, _, p, o, k, d, lang in ROWS}


def plain(rows):
    return {(r["s"][:2], r["p"], r["o"][:2] if r["o_kind"] == "bnode" else r["o"], r["o_kind"], r["o_datatype"], r["o_lang"]) for r in rows}


@pytest.mark.parametrize("form", ["nt", "nq", "ttl", "xml", "json-ld"])
def test_round_trip(spark, tmp_path, form):
    path = str(tmp_path / "g")
    rdf.write_rdf(spark.createDataFrame(ROWS, TRIPLES), path, form, {"x": "http://x/"})
    got = rdf.read_rdf(spark, path, form).collect()
    assert plain(got) == EDGE and len(got) == len(ROWS)
    nodes = {r["s"] for r in got if r["s_kind"] == "bnode"} | {r["o"] for r in got if r["o_kind"] == "bnode"}
    assert len(nodes) == 2


def test_turtle_in_several_files(spark, tmp_path):
    path = str(tmp_path / "g")
    rdf.write_turtle(spark.createDataFrame(ROWS, TRIPLES), path, {"x": "http://x/"}, files=3)
    assert plain(rdf.read_turtle(spark, path).collect()) == EDGE


def test_escapes_graphs_and_bad_lines(spark, tmp_path):
    (tmp_path / "q.nq").write_text('# c\n\n<http://x/\\u00e9> <http://x/p> "a\\u00e9\\U0001F600\\b\\f\\\'\\\\u0041"@en <http://x/g> .\n<http://x/a> <http://x/p> _:b .\nnot a statement\n')
    path = str(tmp_path / "q.nq")
    got = {(r["s"], r["o"], r["o_lang"], r["g"]) for r in rdf.read_nquads(spark, path).collect()}
    assert got == {("http://x/é", "aé😀\b\f'\\u0041", "en", "http://x/g"), ("http://x/a", "_:b", None, None)}
    assert [r["value"] for r in rdf.bad_lines(spark, path).collect()] == ["not a statement"]
    with pytest.raises(Exception, match="no statement"):
        rdf.read_rdf(spark, path, "nq").collect()


def test_trig(spark, tmp_path):
    (tmp_path / "t.trig").write_text('@prefix : <http://x/> . :a :p :b . :g { :a :q 1 ; :r "x" . :c :p :d } GRAPH :h { :e :p :f . }')
    rows = rdf.read_rdf(spark, str(tmp_path / "t.trig"), "trig").collect()
    assert {(r["s"][-1], r["o"][-1], r["g"] and r["g"][-1]) for r in rows} == {("a", "b", None), ("a", "1", "g"), ("a", "x", "g"), ("c", "d", "g"), ("e", "f", "h")}


def test_rdf_xml_forms():
    text = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/" xml:base="http://b/x" xml:lang="en"><e:T rdf:about="a" e:k="v"><e:p rdf:resource="#b"/><e:l xml:lang="de">hallo</e:l>
<e:r rdf:parseType="Resource"><e:z rdf:nodeID="n"/></e:r><e:c rdf:parseType="Collection"><rdf:Description rdf:about="http://e/1"/></e:c><rdf:li>x</rdf:li><rdf:li>y</rdf:li></e:T></rdf:RDF>"""
    got = {(s, p, o, lang) for s, _, p, o, _, _, lang in formats.parse_xml(text)}
    assert {("http://b/a", RDF + "type", "http://e/T", None), ("http://b/a", "http://e/k", "v", "en"), ("http://b/a", "http://e/p", "http://b/x#b", None), ("http://b/a", "http://e/l", "hallo", "de"), ("http://b/a", RDF + "_1", "x", "en"), ("http://b/a", RDF + "_2", "y", "en")} <= got
    assert len(got) == 11


def test_json_ld_forms():
    text = '{"@context": {"e": "http://e/", "name": "e:name", "knows": {"@id": "e:knows", "@type": "@id"}, "@language": "EN"}, "@id": "e:a", "@type": "e:T", "name": ["x", {"@value": "y", "@language": "de"}], "knows": "e:b", "e:n": [3, 2.5, true], "@reverse": {"e:of": {"@id": "e:z"}}}'
    got = {(s, p, o, d, lang) for s, _, p, o, _, d, lang in formats.parse_jsonld(text)}
    assert got == {
        ("http://e/a", RDF + "type", "http://e/T", None, None), ("http://e/a", "http://e/name", "x", None, "en"), ("http://e/a", "http://e/name", "y", None, "de"), ("http://e/a", "http://e/knows", "http://e/b", None, None),
        ("http://e/a", "http://e/n", "3", XSD + "integer", None), ("http://e/a", "http://e/n", "2.5", XSD + "double", None), ("http://e/a", "http://e/n", "true", XSD + "boolean", None), ("http://e/z", "http://e/of", "http://e/a", None, None),
    }
    with pytest.raises(ValueError, match="not inline"):
        formats.parse_jsonld('{"@context": "http://c/", "@id": "a"}')


def test_long_literals(spark, tmp_path):
    """Bodies of a megabyte, of escapes alone, and of what looks like the end of a literal."""
    bodies = ["x" * 1_000_000, '"\\\n\t' * 60_000, '" .\n<a> <b> "', "\\" * 5_001, "ends with \\", "", '\\"', "é \u0085\x0b x"]
    rows = [(f"http://e/{i}", "iri", "http://e/p", b, "literal", None, "en" if i % 2 else None, "http://g/1") for i, b in enumerate(bodies)]
    path = str(tmp_path / "long")
    rdf.write_nquads(spark.createDataFrame(rows, TRIPLES + ", g string"), path)
    got = rdf.read_nquads(spark, path, strict=True).orderBy("s").collect()
    assert [r["o"] for r in got] == bodies and {r["g"] for r in got} == {"http://g/1"}
    assert [r["o_lang"] for r in got] == ["en" if i % 2 else None for i in range(len(bodies))]
    assert rdf.bad_lines(spark, path).count() == 0
    (tmp_path / "bad.nt").write_text('<a> <b> "open ' + "y" * 300_000 + "\n" + '<a> <b> "c" "d" .\n')
    assert rdf.bad_lines(spark, str(tmp_path / "bad.nt")).count() == 2
