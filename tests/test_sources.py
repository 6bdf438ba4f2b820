import io
import json
import threading
import urllib.request

import pytest

from forkline import cli, server
from forkline.errors import SemanticError, SyntacticalError
from forkline.operators import algebra as A
from forkline.sources import copying, ddl, university, wiki
from forkline.streaming import sink
from forkline.vsql import Session

DUMP = """<mediawiki><page><id>7</id><title>A|"b"</title>
<revision><id>1</id><contributor><id>5</id><username>u</username></contributor><text>one
two</text></revision>
<revision><id>2</id><parentid>1</parentid><text></text></revision>
<revision><id>3</id><parentid>1</parentid><contributor><id>5</id><username>u</username></contributor><text>x|y</text></revision></page></mediawiki>"""


def test_wiki(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(DUMP)
    w = wiki.read_wiki(spark, str(tmp_path / "dump.xml"))
    assert [tuple(r) for r in w["page"].collect()] == [(7, "A~'b'")]
    assert sorted(map(tuple, w["revision"].collect())) == [(1, 0, 7, 1, 5), (3, 1, 7, 3, 5)]
    assert sorted(map(tuple, w["content"].collect())) == [(1, "one two"), (3, "x~y")]
    wiki.convert(spark, str(tmp_path / "dump.xml"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/user.tbl")).first()[0] == "5|u"


def test_separated_files(spark, tmp_path):
    s = ddl.parse_schema("create table t (a integer not null, b varchar(5), c numeric(4,2))").relations["t"].spark()
    (tmp_path / "t.tbl").write_text("1|x|2.50|\n2||-1\n")
    assert [tuple(map(str, r)) for r in copying.read_separated(spark, str(tmp_path / "t.tbl"), s, "tbl").collect()] == [("1", "x", "2.50"), ("2", "", "-1.00")]
    (tmp_path / "bad.tbl").write_text("1|x\n")
    with pytest.raises(Exception, match="3 columns"):
        copying.read_separated(spark, str(tmp_path / "bad.tbl"), s, "tbl").collect()
    with pytest.raises(Exception, match="separator"):
        copying.write_separated(spark.createDataFrame([("a;b",)], "x string"), str(tmp_path / "o"), "csv")
    with pytest.raises(SemanticError):
        copying.separator("xml")


def test_schema_files():
    with pytest.raises(SyntacticalError):
        ddl.parse_schema("create table t (a integer")
    with pytest.raises(SemanticError):
        ddl.parse_schema("create table t (a blob)")
    s = ddl.parse_schema('create table "order" (a integer not null, primary key (a)); -- x\ncreate unique index i on "order" (a);')
    assert s.relations["order"].primary_key == ["a"] and s.indexes[0].columns == ["a"]


def test_university_and_loader(spark, tmp_path):
    tables = university.load_university(spark)
    for n, df in tables.items():
        copying.write_separated(df, f"{tmp_path}/{n}.tbl", "tbl")
    again = ddl.load_database(spark, university.declared(), str(tmp_path))
    for n, df in tables.items():
        assert sorted(map(tuple, again[n].collect())) == sorted(map(tuple, df.collect()))
    s = A.F.col("semester")
    assert A.group_by(tables["studenten"], A.count_all("n"), A.sum_of(s, "t"), A.avg_of(s, "a")).first()[:2] == (6, 38)


def test_strict_joins(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,)], "y long")
    with pytest.raises(SemanticError, match="cannot compare 'int' and 'bigint'"):
        A.join(a, b, [("x", "y")], strict=True)
    assert A.join(a, b, [("x", "y")]).count() == 1
    with pytest.raises(SemanticError):
        A.join(a, b, [])


def test_sinks_and_repl(spark):
    out, seen = io.StringIO(), []
    df = spark.createDataFrame([(1, None), (2, "b")], "x int, y string")
    assert sink.print_rows(df, out) == 2 and out.getvalue().splitlines() == ["1\tNULL", "2\tb", "Produced 2 tuples"]
    sink.for_each(df.orderBy("x"), lambda r: seen.append(sink.tuple_text(r)))
    assert seen == ["(1, NULL)", "(2, b)"]
    out = io.StringIO()
    cli.repl(Session(spark), ["CREATE TABLE t ( a INT NOT NULL )", "", "INSERT INTO t VALUES (1)", "SELECT * FROM t", "SELECT b FROM t", "BRANCH", "quit", "SELECT"], out)
    assert out.getvalue().splitlines() == ["1", "Produced 1 tuples", "error: column 'b' does not exist", "Empty result set"]


def test_server(spark):
    s = server.serve(spark, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        r = urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", body and body.encode(), method=method)
        return json.load(urllib.request.urlopen(r))

    n = ask("PUT", "/")["id"]
    out = ask("POST", f"/{n}", "CREATE TABLE t ( a INT NOT NULL ); INSERT INTO t VALUES (1); CREATE BRANCH b FROM master; SELECT * FROM t")
    assert out[-1]["columns"] == ["a"] and out[-1]["content"] == [["1"]] and set(out[-1]["timings"]) == {"parsing", "compilation", "execution"}
    assert ask("GET", f"/{n}") == {"nodes": [{"name": "master", "id": 0, "tuples": 1}, {"name": "b", "id": 1, "tuples": 1}], "links": [{"source": 0, "target": 1, "weight": 1}]}
    with pytest.raises(urllib.error.HTTPError):
        ask("POST", f"/{n}", "SELECT")
    ask("DELETE", f"/{n}")
    with pytest.raises(urllib.error.HTTPError):
        ask("GET", f"/{n}")
    s.shutdown()


def test_bulk_load_takes_all_orders(spark, data, monkeypatch):
    from forkline import versioning
    from forkline.plans import versioned

    loaded, load = [], copying.copy_from
    monkeypatch.setattr(copying, "copy_from", lambda catalog, *how: (load(catalog, *how), loaded.append(catalog)))
    versioned.bulk_load(spark, data)
    want = spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey")
    got = versioning.resolve(loaded[0], "orders").select("o_orderkey")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
