"""Results beyond 10,000 rows (endpoint) and 100 rows (command line) are whole."""

import json
from threading import Thread
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import functions as F

from claimloom import cli
from claimloom.config import Config
from claimloom.schemas import TRIPLES
from claimloom.serve import answer, server

N = 10_050


def many(spark, n):
    iri, none = F.lit("iri"), F.lit(None).cast("string")
    rows = spark.range(n).select(F.concat(F.lit("http://x/"), F.col("id").cast("string")), iri, F.lit("http://x/p"), F.lit("http://x/o"), iri, none, none)
    return spark.createDataFrame(rows.collect(), TRIPLES)


def test_all_rows(spark):
    graph = many(spark, N)
    rows = json.loads(answer(graph, "SELECT ?s { ?s ?p ?o }", {})[1])["results"]["bindings"]
    assert len({r["s"]["value"] for r in rows}) == N
    assert len(json.loads(answer(graph, f"SELECT ?s {{ ?s ?p ?o }} LIMIT {N - 10}", {})[1])["results"]["bindings"]) == N - 10
    assert len(set(answer(graph, "CONSTRUCT { ?o <http://x/of> ?s } WHERE { ?s ?p ?o }", {})[1].splitlines())) == N
    http = server(graph, Config(), port=0)
    Thread(target=http.serve_forever, daemon=True).start()
    with urlopen(f"http://127.0.0.1:{http.server_port}/?query={quote('SELECT ?s { ?s ?p ?o }')}") as r:
        assert json.load(r)["results"]["bindings"] == rows
    http.shutdown()


def test_command_line_shows_all_rows(spark, tmp_path, capsys):
    (tmp_path / "g.nt").write_text("".join(f"<http://x/{i}> <http://x/p> <http://x/o> .\n" for i in range(150)))
    cli.main(["query", "--rdf", str(tmp_path / "g.nt"), "--rdf-format", "nt", "SELECT ?s { ?s ?p ?o }"], spark)
    assert capsys.readouterr().out.count("http://x/") == 150
