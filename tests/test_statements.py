"""Statements end to end, with exact row sets."""

from decimal import Decimal

import pytest

from forkline.errors import SemanticError, SyntacticalError
from forkline.vsql import Session
from forkline.vsql import parser as P

CREATE = "CREATE TABLE professoren ( id INTEGER NOT NULL, name VARCHAR ( 15 ) NOT NULL , rang NUMERIC ( 32 , 8 ) NOT NULL );"
ONE, TWO = "INSERT INTO professoren ( id , name , rang ) VALUES ( 1 , 'kemper' , 4 );", "INSERT INTO professoren ( id , name , rang ) VALUES ( 2 , 'professor2' , 3 );"
FORK = "CREATE BRANCH hello FROM master;"


def rows(db, branch=None):
    version = f" VERSION {branch}" if branch else ""
    return sorted((r["id"], int(r["rang"])) for r in db.sql(f"SELECT id, rang FROM professoren{version};").collect())


@pytest.fixture
def db(spark):
    s = Session(spark)
    s.sql(CREATE)
    return s


@pytest.mark.parametrize(
    "script, master, hello",
    [
        ([ONE], [(1, 4)], None),
        ([ONE, FORK, TWO.replace("professoren", "professoren VERSION hello")], [(1, 4)], [(1, 4), (2, 3)]),
        ([ONE, "UPDATE professoren SET rang = 5 WHERE id = 1;"], [(1, 5)], None),
        ([ONE, FORK, "UPDATE professoren VERSION hello SET rang = 5 WHERE id = 1;"], [(1, 4)], [(1, 5)]),
        ([ONE, FORK, "UPDATE professoren SET rang = 5 WHERE id = 1;"], [(1, 5)], [(1, 4)]),
        ([ONE, TWO, "DELETE FROM professoren WHERE id = 1;"], [(2, 3)], None),
        ([ONE, TWO, FORK, "DELETE FROM professoren WHERE id = 1;"], [(2, 3)], [(1, 4), (2, 3)]),
        ([ONE, TWO, FORK, "DELETE FROM professoren VERSION hello WHERE id = 1;"], [(1, 4), (2, 3)], [(2, 3)]),
        ([ONE, TWO, "DELETE FROM professoren;"], [], None),
        ([ONE, TWO, "UPDATE professoren SET rang = 1;"], [(1, 1), (2, 1)], None),
    ],
)
def test_scripts(db, script, master, hello):
    for s in script:
        db.sql(s)
    assert rows(db) == master
    if hello is not None:
        assert rows(db, "hello") == hello


def test_an_older_image_never_comes_back(db):
    db.script(ONE + "UPDATE professoren SET rang = 5 WHERE id = 1;")
    assert db.sql("SELECT id FROM professoren WHERE rang = 4").count() == 0


def test_delete_reports_how_many(db):
    db.script(ONE + TWO)
    assert db.sql("DELETE FROM professoren WHERE id = 2").first()[0] == 1


def test_select_list_order_duplicates_and_empty_strings(db):
    db.script(ONE + "UPDATE professoren SET name = '' WHERE id = 1")
    r = db.sql("SELECT rang, id, id, name FROM professoren").first()
    assert tuple(r) == (Decimal("4.00000000"), 1, 1, "")


def test_joins_apply_every_condition(spark, db):
    db.script(ONE + TWO + "CREATE TABLE t ( k INTEGER NOT NULL, w INTEGER NOT NULL ); INSERT INTO t VALUES (1, 1); INSERT INTO t VALUES (2, 9);")
    assert [tuple(r) for r in db.sql("SELECT k FROM t, professoren WHERE k = id AND w = id").collect()] == [(1,)]
    assert db.sql("SELECT a.k, b.k FROM t a, t b").count() == 4
    assert db.sql("SELECT a.k FROM t a, t b WHERE a.k = b.w").count() == 1


@pytest.mark.parametrize(
    "text, message",
    [
        ("SELECT x FROM professoren", "column 'x'"),
        ("SELECT id FROM nobody", "table 'nobody'"),
        ("SELECT id FROM professoren VERSION nope", "branch 'nope'"),
        ("SELECT q.id FROM professoren p", "binding 'q'"),
        ("SELECT id FROM professoren a, professoren b", "ambiguous"),
        ("SELECT id FROM professoren, professoren", "twice"),
        ("INSERT INTO professoren VALUES (1, 'a')", "3 columns"),
        ("INSERT INTO professoren VALUES (1, 'longer than fifteen', 1)", "type mismatch"),
        ("INSERT INTO professoren VALUES ('x', 'a', 1)", "no integer"),
        ("UPDATE professoren SET nope = 1", "column 'nope'"),
        (CREATE, "already exists"),
        ("CREATE TABLE a ( x WHATEVER NOT NULL )", "unknown type"),
        ("CREATE TABLE a ( x INT NOT NULL, x INT NOT NULL )", "twice"),
        ("CREATE BRANCH master FROM master", "already exists"),
        ("CREATE BRANCH b FROM nope", "branch 'nope'"),
        ("COPY nobody FROM 'x' WITH FORMAT csv", "table 'nobody'"),
    ],
)
def test_semantic_errors(db, text, message):
    with pytest.raises(SemanticError, match=message):
        db.sql(text)


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT FROM t", "SELECT a FROM t WHERE a < 1", "SELECT a b FROM t", "DELETE t", "INSERT INTO t VALUES 1", "COPY t VERSION b FROM 'x' WITH FORMAT csv", "COPY t FROM 'x' WITH FORMAT xml", "SELECT a FROM t; x"])
def test_syntax_errors(text):
    with pytest.raises(SyntacticalError):
        P.parse(text)


def test_parser():
    assert P.parse("select name from professoren p") == P.Select([P.Name("name")], [P.Relation("professoren", "master", "p")])
    assert P.parse("SELECT * FROM a, b VERSION x c WHERE c.k=4 AND a.k = c.k;") == P.Select(None, [P.Relation("a"), P.Relation("b", "x", "c")], [(P.Name("k", "c"), P.Literal("4")), (P.Name("k", "a"), P.Name("k", "c"))])
    assert P.split("a 'x;y'; b;\n c") == ["a 'x;y'", "b", "c"]
    assert P.parse("INSERT INTO t VALUES ('Hello World!', 'it''s')").values[1].text == "it's"
