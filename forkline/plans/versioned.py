"""Queries over branches. Each builds its own database over the customers (which stay where
they are: only changes are written) and reads one branch of it."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import dml
from .. import versioning as V
from ..catalog import Catalog
from ..sources import copying
from ..sources.ddl import parse_schema
from ..storage import shared_folder
from ..vsql import Session
from .tables import d, m, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
_ALL = ", ".join(COLUMNS)
NEW = {"c_custkey": 90000001, "c_name": "Customer#new", "c_nationkey": 3, "c_mktsegment": "NEW"}
_NEW = "SELECT CAST(90000001 AS BIGINT) AS c_custkey, 'Customer#new' AS c_name, CAST(3 AS INTEGER) AS c_nationkey, 'NEW' AS c_mktsegment"


def database(spark, sf_dir) -> Catalog:
    c = Catalog(spark)
    c.register("customer", table(spark, sf_dir, "customer").select(*COLUMNS), "c_custkey")
    return c


def _set(c: Catalog, value: str, nation: int, branch: str) -> None:
    dml.update(c, "customer", {"c_mktsegment": F.lit(value)}, F.col("c_nationkey") == nation, branch)


def _case(*changes: tuple[int, str]) -> str:
    """The customers after updates by nation."""
    whens = " ".join(f"WHEN c_nationkey = {n} THEN '{v}'" for n, v in changes)
    return f"SELECT c_custkey, c_name, c_nationkey, CASE {whens} ELSE c_mktsegment END AS c_mktsegment FROM customer"


@query(f"SELECT {_ALL} FROM customer")
def version_master_select(spark, sf_dir):
    return V.resolve(database(spark, sf_dir), "customer")


@query(_case((3, "FORKED")))
def version_branch_select(spark, sf_dir):
    c = database(spark, sf_dir)
    c.create_branch("b1")
    _set(c, "FORKED", 3, "b1")
    return V.resolve(c, "customer", "b1")


@query(f"SELECT {_ALL} FROM customer UNION ALL {_NEW}")
def version_branch_insert(spark, sf_dir):
    c = database(spark, sf_dir)
    c.create_branch("b1")
    dml.insert_values(c, "customer", NEW, "b1")
    return V.resolve(c, "customer", "b1")


@query(f"SELECT {_ALL} FROM customer")
def version_branch_insert_isolated(spark, sf_dir):
    """What a branch inserts isn't in master."""
    c = database(spark, sf_dir)
    c.create_branch("b1")
    dml.insert_values(c, "customer", NEW, "b1")
    return V.resolve(c, "customer")


@query(f"SELECT * FROM ({_case((3, 'TWICE'), (4, 'ONCE'))}) WHERE c_mktsegment IN ('TWICE', 'ONCE', 'FORKED')")
def version_branch_update(spark, sf_dir):
    """A row that was updated twice is found by its last value only."""
    c = database(spark, sf_dir)
    c.create_branch("b1")
    _set(c, "FORKED", 3, "b1")
    _set(c, "TWICE", 3, "b1")
    _set(c, "ONCE", 4, "b1")
    return V.resolve(c, "customer", "b1").where(F.col("c_mktsegment").isin("TWICE", "ONCE", "FORKED"))


@query(f"SELECT {_ALL} FROM customer WHERE c_nationkey <> 5")
def version_branch_delete(spark, sf_dir):
    c = database(spark, sf_dir)
    c.create_branch("b1")
    dml.delete(c, "customer", F.col("c_nationkey") == 5, "b1")
    return V.resolve(c, "customer", "b1")


@query(f"SELECT {_ALL} FROM customer")
def version_master_update_isolated(spark, sf_dir):
    """A branch doesn't see what its parent changes after the fork."""
    c = database(spark, sf_dir)
    c.create_branch("b1")
    _set(c, "MASTER", 7, "master")
    return V.resolve(c, "customer", "b1")


@query(_case((7, "MASTER")))
def version_master_update(spark, sf_dir):
    c = database(spark, sf_dir)
    c.create_branch("b1")
    _set(c, "MASTER", 7, "master")
    _set(c, "FORKED", 8, "b1")
    return V.resolve(c, "customer")


@query(f"SELECT {_ALL} FROM customer")
def version_master_delete_isolated(spark, sf_dir):
    c = database(spark, sf_dir)
    c.create_branch("b1")
    dml.delete(c, "customer", F.col("c_nationkey") == 9, "master")
    return V.resolve(c, "customer", "b1")


@query(f"SELECT {_ALL} FROM customer WHERE c_nationkey <> 9 UNION ALL {_NEW}")
def version_master_changes(spark, sf_dir):
    c = database(spark, sf_dir)
    dml.delete(c, "customer", F.col("c_nationkey") == 9)
    dml.insert_values(c, "customer", NEW)
    return V.resolve(c, "customer")


def _family(spark, sf_dir) -> Catalog:
    c = database(spark, sf_dir)
    c.create_branch("b1")
    _set(c, "CHILD", 3, "b1")
    c.create_branch("b2", "b1")
    _set(c, "LATER", 4, "b1")
    _set(c, "GRANDCHILD", 6, "b2")
    c.create_branch("sibling")
    _set(c, "SIBLING", 3, "sibling")
    return c


@query(_case((3, "CHILD"), (6, "GRANDCHILD")))
def version_grandchild(spark, sf_dir):
    return V.resolve(_family(spark, sf_dir), "customer", "b2")


@query(_case((3, "SIBLING")))
def version_sibling(spark, sf_dir):
    return V.resolve(_family(spark, sf_dir), "customer", "sibling")


@query(f"SELECT a.c_custkey, a.c_mktsegment AS left_segment, b.c_mktsegment AS right_segment FROM ({_case((3, 'CHILD'), (6, 'GRANDCHILD'))}) a JOIN ({_case((3, 'SIBLING'))}) b ON a.c_custkey = b.c_custkey")
def version_cross_join(spark, sf_dir):
    """The same table in two branches, joined."""
    db = Session(spark, _family(spark, sf_dir))
    out = db.sql("SELECT a.c_custkey, a.c_mktsegment, b.c_mktsegment FROM customer VERSION b2 a, customer VERSION sibling b WHERE a.c_custkey = b.c_custkey")
    return out.toDF("c_custkey", "left_segment", "right_segment")


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (3, 4) THEN 'changed' END AS change FROM customer WHERE c_nationkey IN (3, 4)")
def version_diff(spark, sf_dir):
    return V.diff(_family(spark, sf_dir), "customer", "master", "b1").select(F.col("_tid").alias("c_custkey"), "change")


@query(f"SELECT {_ALL} FROM customer WHERE c_nationkey <> 4")
def version_earliest(spark, sf_dir):
    """The first images of the rows that are still live."""
    c = _family(spark, sf_dir)
    dml.delete(c, "customer", F.col("c_nationkey") == 4, "b1")
    return V.earliest(c, "customer", "b1")


@query(f"SELECT * FROM ({_case((3, 'CHILD'))}) WHERE c_nationkey = 3 UNION ALL SELECT {_ALL} FROM customer WHERE c_nationkey = 4")
def version_revision_1(spark, sf_dir):
    """One write back: of nation 3 the first update, of nation 4 the original."""
    c = _family(spark, sf_dir)
    _set(c, "CHILD2", 3, "b1")
    return V.revision(c, "customer", 1, "b1")


@query("SELECT c_custkey, CAST(CASE WHEN c_nationkey IN (3, 4) THEN 2 ELSE 1 END AS BIGINT) AS n_versions FROM customer")
def version_history_count(spark, sf_dir):
    return V.history(_family(spark, sf_dir), "customer", "b1").select(F.col("_tid").alias("c_custkey"), "n_versions")


@query(f"SELECT {_ALL} FROM customer WHERE c_custkey = 42")
def version_point(spark, sf_dir):
    return V.point(_family(spark, sf_dir), "customer", 42, "b2")


@query(_NEW)
def version_root_branch(spark, sf_dir):
    """A branch without a parent starts empty."""
    c = database(spark, sf_dir)
    c.create_branch("root", None)
    dml.insert_values(c, "customer", NEW, "root")
    return V.resolve(c, "customer", "root")


@query("SELECT c_custkey, c_mktsegment FROM (" + _case((3, "B12")) + ") WHERE c_nationkey = 3")
def version_many_branches(spark, sf_dir):
    """Twelve branches, one below the other."""
    c = database(spark, sf_dir)
    for k in range(1, 13):
        c.create_branch(f"b{k}", f"b{k - 1}" if k > 1 else "master")
        if k in (1, 12):
            _set(c, f"B{k}", 3, f"b{k}")
    return V.resolve(c, "customer", "b12").where(F.col("c_nationkey") == 3).select("c_custkey", "c_mktsegment")


@query(_case((3, "CHILD"), (4, "LATER")))
def version_compacted(spark, sf_dir):
    c = _family(spark, sf_dir)
    dml.compact(c, "customer")
    return V.resolve(c, "customer", "b1")


@query("SELECT * FROM (VALUES ('b1', 'master'), ('b2', 'b1'), ('sibling', 'master')) v(branch, parent)")
def branches(spark, sf_dir):
    c = Catalog(spark)
    for name, parent in (("b1", "master"), ("b2", "b1"), ("sibling", "master")):
        c.create_branch(name, parent)
    return Session(spark, c).sql("BRANCH")


@query("SELECT * FROM (VALUES (0, 1, 1), (1, 2, 1), (0, 3, 1)) v(source, target, weight)")
def lineage_edges(spark, sf_dir):
    c = Catalog(spark)
    for name, parent in (("b1", "master"), ("b2", "b1"), ("sibling", "master")):
        c.create_branch(name, parent)
    return spark.createDataFrame([(x["source"], x["target"], x["weight"]) for x in c.graph()["links"]], "source int, target int, weight int")


# The wiki workload as statements: page(id, title, userid, content) and user(id, name)


def wiki_session(spark, sf_dir) -> Session:
    """Pages with their whole contents; branch1 was forked before master's updates, branch2 after some."""
    c = Catalog(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.col("url").alias("title"), (F.col("page_id") % 1500).alias("userid"), F.col("html").alias("content"))
    c.register("page", pages, "id")
    c.register("user", spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")
    db = Session(spark, c)
    db.sql("CREATE BRANCH branch1 FROM master;")
    db.sql("UPDATE page SET content = 'second' WHERE id = 17;")
    db.sql("CREATE BRANCH branch2 FROM master;")
    db.sql("UPDATE page SET content = 'third' WHERE id = 17;")
    return db


def _wiki(name: str, statements: list[str], sql: str):
    def run(spark, sf_dir):
        db = wiki_session(spark, sf_dir)
        out = None
        for s in statements:
            out = db.sql(s)
        return out

    run.__name__ = name
    query(sql)(run)


def _page(content: str) -> str:
    return f"SELECT '{content}' AS content FROM pages WHERE page_id = 17"


_USER = "SELECT c_name AS name FROM customer, pages WHERE page_id % 1500 = c_custkey AND page_id = 17"
_wiki("wiki_t1_select_master", ["SELECT content FROM page p WHERE p.id = 17;"], _page("third"))
_wiki("wiki_t2_select_branch1", ["SELECT content FROM page VERSION branch1 p WHERE p.id = 17;"], "SELECT html AS content FROM pages WHERE page_id = 17")
_wiki("wiki_t3_select_branch2", ["SELECT content FROM page VERSION branch2 p WHERE p.id = 17;"], _page("second"))
_wiki("wiki_t4_join_master", ["SELECT name FROM user u , page p WHERE p.userid = u.id AND p.id = 17;"], _USER)
_wiki("wiki_t5_join_branch1", ["SELECT name FROM user u , page VERSION branch1 p WHERE p.userid = u.id AND p.id = 17;"], _USER)
_wiki("wiki_t6_join_branch2", ["SELECT name FROM user u , page VERSION branch2 p WHERE p.userid = u.id AND p.id = 17;"], _USER)
for _k, _branch in enumerate(("", " VERSION branch1", " VERSION branch2")):
    _after = f"SELECT page_id AS id, CASE WHEN page_id = 17 THEN 'Hello World!' ELSE html END AS content FROM pages"
    _wiki(f"wiki_t{7 + _k}_update", [f"UPDATE page{_branch} SET content = 'Hello World!' WHERE id = 17;", f"SELECT id, content FROM page{_branch};"], _after)
_PAGE_NEW = "SELECT page_id AS id FROM pages UNION ALL SELECT 80000001"
for _k, _branch in enumerate(("", " VERSION branch1")):
    _wiki(f"wiki_t{10 + _k}_insert", [f"INSERT INTO page{_branch} ( content , id , title , userid ) VALUES ( 'Hello World!' , 80000001 , 't' , 5 );", f"SELECT id FROM page{_branch};"], _PAGE_NEW)
for _k, _branch in enumerate(("", " VERSION branch1", " VERSION branch2")):
    _wiki(f"wiki_t{12 + _k}_delete", [f"DELETE FROM page{_branch} WHERE id = 17;", f"SELECT id FROM page{_branch};"], "SELECT page_id AS id FROM pages WHERE page_id <> 17")


# The same wiki without versions of rows: a page's contents are revisions in plain relations


_CONTENT_ID, _REVISION_ID = 90000001, 90000002


def _plain_wiki(spark, sf_dir) -> Session:
    docs, c = spark.read.parquet(f"{sf_dir}/documents.parquet"), Catalog(spark)
    i = F.col("doc_id")
    c.register("revision", docs.select(i.alias("id"), (i % 250).alias("page"), i.alias("content"), (i % 1500).alias("author")), "id")
    c.register("content", docs.select(i.alias("id"), "text"), "id")
    return Session(spark, c)


def _plain(name: str, statements: list[str], sql: str):
    def run(spark, sf_dir):
        db = _plain_wiki(spark, sf_dir)
        for s in statements:
            db.sql(s)
        return db.sql("SELECT r.id, r.page, t.text FROM content t, revision r WHERE t.id = r.content;").toDF("id", "page", "text")

    run.__name__ = name
    query(sql)(run)


_REVISIONS = "SELECT doc_id AS id, doc_id % 250 AS page, text FROM documents"
_ADD = [f"INSERT INTO content ( text , id ) VALUES ( 'A new text.' , {_CONTENT_ID} );", f"INSERT INTO revision ( content , page , author , id ) VALUES ( {_CONTENT_ID} , 17 , 5 , {_REVISION_ID} );"]
_plain("wiki_unversioned_insert", _ADD, f"{_REVISIONS} UNION ALL SELECT {_REVISION_ID}, 17, 'A new text.'")
_plain("wiki_unversioned_update", ["UPDATE content SET text = 'Rewritten.' WHERE id = 17;", *_ADD], f"SELECT doc_id AS id, doc_id % 250 AS page, CASE WHEN doc_id = 17 THEN 'Rewritten.' ELSE text END AS text FROM documents UNION ALL SELECT {_REVISION_ID}, 17, 'A new text.'")
_plain("wiki_unversioned_delete", ["DELETE FROM revision WHERE page = 17;", "DELETE FROM content WHERE id = 17;"], f"{_REVISIONS} WHERE doc_id % 250 <> 17")


# Sums over a branch with a long log


@query("SELECT CAST(sum(o_orderkey + CASE left(o_orderpriority, 1) WHEN '5' THEN o_custkey ELSE CAST(left(o_orderpriority, 1) AS BIGINT) * 10 END + year(o_orderdate)) AS BIGINT) AS total, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW'")
def version_tuple_sum(spark, sf_dir):
    """Every row of a branch in which most were changed, some of them twice, and some deleted."""
    c = Catalog(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"))
    c.register("purchase", orders, "o_orderkey")
    c.create_branch("b1")
    for k in (3, 1, 2, 3, 4):
        dml.update(c, "purchase", {"o_custkey": F.lit(k * 10)}, F.col("o_orderpriority").startswith(str(k)), "b1")
    dml.delete(c, "purchase", (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), "b1")
    dml.update(c, "purchase", {"o_custkey": F.lit(0)}, F.col("o_orderstatus") == "O")  # master's, not the branch's
    rows = V.resolve(c, "purchase", "b1")
    return rows.agg(F.sum(F.col("o_orderkey") + F.col("o_custkey") + F.col("year")).alias("total"), F.count(F.lit(1)).alias("n"))


# Joins of a warehouse: keys of several columns and literals


def _warehouse(spark, sf_dir) -> Session:
    """Depots are nations, areas ten for each; buyers, purchases and lines carry their depot and area."""
    c, read = Catalog(spark), lambda t: table(spark, sf_dir, t)
    c.register("depot", read("nation").select(F.col("n_nationkey").cast("long").alias("w"), F.col("n_name").alias("title")), "w")
    n = F.col("id")
    c.register("area", spark.range(250).select(n.alias("key"), F.floor(n / 10).alias("w"), (n % 10).alias("a"), F.concat(F.lit("area "), n).alias("title")), "key")
    buyers = read("customer").select(F.col("c_custkey").alias("b"), F.col("c_nationkey").cast("long").alias("w"), (F.col("c_custkey") % 10).alias("a"), F.col("c_name").alias("given"), F.col("c_mktsegment").alias("family"))
    c.register("buyer", buyers, "b")
    orders = read("orders").select(F.col("o_orderkey").alias("p"), F.col("o_custkey").alias("b")).join(buyers.select("b", "w", "a"), "b").select("p", "b", "w", "a")
    c.register("purchase", orders, "p")
    c.register("article", read("part").select(F.col("p_partkey").alias("i"), F.col("p_name").alias("title")), "i")
    lines = read("lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_linenumber").cast("long").alias("number"), F.col("l_partkey").alias("i"), F.col("l_returnflag").alias("info"))
    # No line is ever changed here, so its key needn't be unique.
    c.register("line", lines.join(orders, "p").select((F.col("p") * 8 + F.col("number")).alias("key"), "p", "w", "a", "number", "i", "info"), "key")
    return Session(spark, c)


_WAREHOUSE = """WITH depot AS (SELECT CAST(n_nationkey AS BIGINT) AS w, n_name AS title FROM nation),
area AS (SELECT range // 10 AS w, range % 10 AS a, 'area ' || range AS title FROM range(250)),
buyer AS (SELECT c_custkey AS b, CAST(c_nationkey AS BIGINT) AS w, c_custkey % 10 AS a, c_name AS given, c_mktsegment AS family FROM customer),
purchase AS (SELECT o_orderkey AS p, b, w, a FROM orders JOIN buyer ON o_custkey = b),
article AS (SELECT p_partkey AS i, p_name AS title FROM part),
line AS (SELECT p, w, a, CAST(l_linenumber AS BIGINT) AS number, l_partkey AS i, l_returnflag AS info FROM lineitem JOIN purchase ON l_orderkey = p)
"""


def _tpcc(name: str, statement: str, columns: str):
    def run(spark, sf_dir):
        return _warehouse(spark, sf_dir).sql(statement).toDF(*columns.split())

    run.__name__ = name
    head, tail = statement.rstrip(";").split(" FROM ")
    named = ", ".join(f"{c} AS {n}" for c, n in zip(head.removeprefix("SELECT ").split(", "), columns.split()))
    query(f"{_WAREHOUSE}SELECT {named} FROM {tail}")(run)


_KEYS = "l.p = o.p AND l.a = o.a AND l.w = o.w"
_tpcc("tpcc_q1", "SELECT w FROM depot d;", "w")
_tpcc("tpcc_q2", "SELECT b, given, family FROM buyer b WHERE b.family = 'BUILDING';", "b given family")
_tpcc("tpcc_q3", "SELECT r.title FROM area r, purchase o WHERE r.w = o.w AND r.a = o.a AND o.p = 7;", "title")
_tpcc("tpcc_q4", f"SELECT o.p, l.info FROM purchase o, line l WHERE {_KEYS} AND l.number = 1 AND l.p = 100;", "p info")
_tpcc("tpcc_q5", f"SELECT o.p, l.info FROM line l, purchase o WHERE {_KEYS} AND l.number = 1;", "p info")
_tpcc("tpcc_q6", f"SELECT u.family, o.p, t.i, l.info FROM buyer u, purchase o, line l, article t WHERE u.b = o.b AND u.a = o.a AND u.w = o.w AND {_KEYS} AND l.number = 1 AND t.i = l.i;", "family p i info")
_tpcc("tpcc_q7", f"SELECT u.family, o.p, l.info FROM buyer u, purchase o, line l WHERE u.b = o.b AND {_KEYS} AND l.number = 1 AND l.p = 100;", "family p info")


# Statements, files and schemas


@query("SELECT * FROM (VALUES (1, 'first', CAST(5 AS DECIMAL(32,8)), DATE '2020-02-29', TRUE), (2, 'it''s; quoted', CAST(3.25 AS DECIMAL(32,8)), DATE '1999-12-31', FALSE)) v(id, name, score, day, ok)")
def statements(spark, sf_dir):
    db = Session(spark)
    db.script("""
      CREATE TABLE t ( id INTEGER NOT NULL, name VARCHAR ( 15 ) NOT NULL , score NUMERIC ( 32 , 8 ) NOT NULL, day DATE NOT NULL, ok BOOL NOT NULL );
      INSERT INTO t VALUES (1, 'first', 4, '2020-02-29', 'true');
      INSERT INTO t (name, ok, id, day, score) VALUES ('it''s; quoted', 'false', 2, '1999-12-31', 3.25);
      INSERT INTO t VALUES (3, 'gone', 1, '2000-01-01', 'true');
      DELETE FROM t WHERE id = 3;
      UPDATE t SET score = 5 WHERE id = 1;
    """)
    return db.sql("SELECT * FROM t")


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _copied(spark, sf_dir, kind: str, branch: bool):
    """To a file and from there into another table."""
    c, folder = Catalog(spark), shared_folder(spark)
    c.register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")
    c.create_table("nation2", c.table("nation").schema)
    db, version = Session(spark, c), ""
    if branch:
        db.sql("CREATE BRANCH b FROM master")
        db.sql("DELETE FROM nation VERSION b WHERE n_regionkey = 2")
        version = " VERSION b"
    path = os.path.join(folder, f"nation.{kind}")
    db.sql(f"COPY nation{version} TO '{path}' WITH FORMAT {kind}")
    db.sql(f"COPY nation2 FROM '{path}' WITH FORMAT {kind}")
    return db.sql("SELECT * FROM nation2")


@query(_NATION)
def copy_roundtrip_csv(spark, sf_dir):
    return _copied(spark, sf_dir, "csv", False)


@query(_NATION + " WHERE n_regionkey <> 2")
def copy_roundtrip_tbl(spark, sf_dir):
    return _copied(spark, sf_dir, "tbl", True)


@query("SELECT * FROM (VALUES ('', 'a'), ('x', ''), ('', '')) v(one, other)")
def copy_empty_texts(spark, sf_dir):
    """Empty texts survive a file, in a table of one column (where they are empty lines) too."""
    db, folder = Session(spark), shared_folder(spark)
    db.script("CREATE TABLE t ( one TEXT NOT NULL, other TEXT NOT NULL ); CREATE TABLE u ( one TEXT NOT NULL, other TEXT NOT NULL ); CREATE TABLE single ( one TEXT NOT NULL ); CREATE TABLE back ( one TEXT NOT NULL )")
    for a, b in (("", "a"), ("x", ""), ("", "")):
        db.sql(f"INSERT INTO t VALUES ('{a}', '{b}')")
        db.sql(f"INSERT INTO single VALUES ('{a}')")
    for source, target in (("t", "u"), ("single", "back")):
        db.sql(f"COPY {source} TO '{folder}/{target}' WITH FORMAT csv")
        db.sql(f"COPY {target} FROM '{folder}/{target}' WITH FORMAT csv")
    pairs, ones = db.sql("SELECT * FROM u"), db.sql("SELECT * FROM back").groupBy("one").agg(F.count(F.lit(1)).alias("n"))
    times = pairs.groupBy("one").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(ones.intersect(times).select("one"), "one").select("one", "other")


@query(f"SELECT o_orderkey, {m('o_totalprice')} AS o_totalprice, {d('o_orderdate')} AS o_orderdate FROM orders")
def bulk_load(spark, sf_dir):
    """All orders through a .tbl file into a log-backed table."""
    c, folder = Catalog(spark), shared_folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    copying.write_separated(o, f"{folder}/orders.tbl", "tbl")
    c.create_table("orders", o.schema)
    copying.copy_from(c, "orders", f"{folder}/orders.tbl", "tbl")
    return V.resolve(c, "orders")


_DDL = """
-- a warehouse and what it stocks
create table warehouse ( w_id integer not null, w_name varchar(10), w_tax numeric(4,4), primary key (w_id) );
create table "order" ( o_id integer not null, o_entry timestamp not null, o_note char(3), primary key (o_id, o_entry) );
create index by_entry on "order" (o_entry, o_id);
"""


@query("SELECT * FROM (VALUES ('warehouse', 0, 'w_id', 'integer', FALSE, TRUE), ('warehouse', 1, 'w_name', 'varchar(10)', TRUE, FALSE), ('warehouse', 2, 'w_tax', 'numeric(4,4)', TRUE, FALSE), ('order', 0, 'o_id', 'integer', FALSE, TRUE), ('order', 1, 'o_entry', 'timestamp', FALSE, TRUE), ('order', 2, 'o_note', 'char(3)', TRUE, FALSE)) v(relation, position, \"column\", type, nullable, in_key)")
def schema_ddl_columns(spark, sf_dir):
    return parse_schema(_DDL).rows(spark)
