"""Files in and out, streams, and registered queries."""

import duckdb
import pytest

import __spark_entry__
from trigrove.plans import catalog
from trigrove.sources import files
from trigrove.streaming.merge import merge_stream

TRIPLE = "e1 string, rel string, e2 string, ordinal long"


def test_text_documents(spark, tmp_path):
    for name, data in (("a.txt", "你好\r\n世界".encode()), ("b.TXT", "你好，世界".encode("gbk")), ("c.txt", b" \n"), ("d.pdf", b"x"), ("e.txt", "﻿mark".encode())):
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_text_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "你好\n世界" and rows["b.TXT"].text == "你好，世界" and rows["e.txt"].text == "mark"
    assert {k: r.status for k, r in rows.items()} == {"a.txt": "ok", "b.TXT": "ok", "c.txt": "empty", "d.pdf": "unsupported", "e.txt": "ok"}


def test_triples_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\"b", "r", "c,d", 0), ("x", "r", None, 1), ("NA", "r", "line\nend", 2)], TRIPLE)
    path = str(tmp_path / "out")
    assert files.export_triples_csv(df, path) and not files.export_triples_csv(df.limit(0), path)
    assert files.read_triples_csv(spark, str(tmp_path / "none")).count() == 0
    got = files.read_triples_csv(spark, path)
    assert got.count() == 2 and files.read_triples_csv(spark, path, na_tokens=("NA",)).count() == 1


def test_write_triples(spark, tmp_path):
    df = spark.createDataFrame([("a", "r", "b", 0), ("a", "r", "b", 1)], TRIPLE)
    path = str(tmp_path / "t")
    assert not files.write_triples(df.limit(0), path)
    files.write_triples(df, path, "overwrite")
    assert spark.read.parquet(path).count() == 2
    files.write_triples(df.selectExpr("'n' as e1", "rel", "e2", "ordinal"), path)
    assert spark.read.parquet(path).count() == 3


def test_graph_script_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a'b", "位于", 'c"\\', 0), ("d", "REL", "e", 1), ("f", "x`y", "g", 2)], TRIPLE)
    path = str(tmp_path / "s")
    files.write_graph_script(df, path)
    assert sorted(tuple(r) for r in files.read_graph_script(spark, path).collect()) == sorted((r.e1, r.rel, r.e2) for r in df.collect())


def test_stream_merges_once(spark, tmp_path):
    src, nodes, edges = (str(tmp_path / n) for n in ("src", "nodes", "edges"))
    df = spark.createDataFrame([("a", "r", "b", 0), ("a", "r", "b", 1), ("b", "r", "a", 2)], TRIPLE)
    for _ in range(2):
        df.write.mode("append").parquet(src)
        merge_stream(spark.readStream.schema(TRIPLE).parquet(src), nodes, edges, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(nodes).count() == 2 and spark.read.parquet(edges).count() == 2


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["rule_extract", "carry_subject", "chunk_text", "clean_triples", "expand_conjunctions", "svo_relations", "apply_verdicts", "viz_nodes", "import_plan", "read_graph_script", "gazetteer_mentions"])
def test_queries_match_their_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr([r[names.index(c)] for c in cols]) for r in cur.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "ordinal", "e1", "rel", "e2"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
