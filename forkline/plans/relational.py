"""Queries over the relational tables: filters, joins, groups, arithmetic."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import algebra as A
from ..sources.university import load_university
from .tables import d, m, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def dec(c, scale: int = 4):
    return c.cast(f"decimal(38,{scale})")


def _average(column: str, alias: str) -> str:
    """Exactly, as the quotient of whole hundredths."""
    return f"CAST(CAST(CAST(sum(CAST({m(column)} * 100 AS BIGINT)) AS HUGEINT) // count({column}) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS {alias}"


def _q1(lineitem: str, order: str = "") -> str:
    return f"""
SELECT l_returnflag, l_linestatus,
 CAST(sum({m('l_quantity')}) AS DECIMAL(38,2)) AS sum_qty,
 CAST(sum({m('l_extendedprice')}) AS DECIMAL(38,2)) AS sum_base_price,
 CAST(sum({m('l_extendedprice')} * (1 - {m('l_discount')})) AS DECIMAL(38,4)) AS sum_disc_price,
 CAST(sum({m('l_extendedprice')} * (1 - {m('l_discount')}) * (1 + {m('l_tax')})) AS DECIMAL(38,6)) AS sum_charge,
 {_average('l_quantity', 'avg_qty')}, {_average('l_extendedprice', 'avg_price')}, {_average('l_discount', 'avg_disc')},
 count(*) AS count_order, count(l_tax) AS count_tax
FROM {lineitem} WHERE {d('l_shipdate')} <= DATE '1998-09-02' GROUP BY 1, 2 {order}"""


def _pricing_summary(lineitem):
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    one = F.lit(1).cast("decimal(15,2)")
    return A.group_by(
        A.select(lineitem, A.compare("<=", F.col("l_shipdate"), F.lit("1998-09-02").cast("date"))),
        A.keep("l_returnflag"),
        A.keep("l_linestatus"),
        ("agg", dec(F.sum("l_quantity"), 2), "sum_qty"),
        ("agg", dec(F.sum("l_extendedprice"), 2), "sum_base_price"),
        ("agg", dec(F.sum(price * (one - disc)), 4), "sum_disc_price"),
        ("agg", dec(F.sum((price * (one - disc)).cast("decimal(20,4)") * (one + tax)), 6), "sum_charge"),
        A.avg_of(F.col("l_quantity"), "avg_qty", 2),
        A.avg_of(price, "avg_price", 2),
        A.avg_of(disc, "avg_disc", 2),
        A.count_all("count_order"),
        ("agg", F.count(tax), "count_tax"),
    )


@query(_q1("lineitem"))
def tpch1(spark, sf_dir):
    return _pricing_summary(table(spark, sf_dir, "lineitem"))


@query(_q1("lineitem", "ORDER BY l_returnflag, l_linestatus"))
def tpch1_sorted(spark, sf_dir):
    """The same, sorted by its groups: a handful of rows."""
    return _pricing_summary(table(spark, sf_dir, "lineitem")).orderBy("l_returnflag", "l_linestatus")


_NULLED = "(SELECT * REPLACE (CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS l_tax, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity END AS l_quantity, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_discount END AS l_discount) FROM lineitem)"


@query(_q1(_NULLED))
def tpch1_null(spark, sf_dir):
    """The whole pricing summary where some inputs are null: sums and averages leave them out."""
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    return _pricing_summary(li.withColumns({"l_tax": F.when(n != 7, F.col("l_tax")), "l_quantity": F.when(n != 6, F.col("l_quantity")), "l_discount": F.when(n != 5, F.col("l_discount"))}))


# Arithmetic: polynomials by Horner's scheme. x is l_discount in hundredths in the SQL.
_X = "CAST(round(l_discount * 100) AS BIGINT)"
COEFFICIENTS = (Decimal("0.37"), Decimal("0.82"), Decimal("0.15"), Decimal("0.64"), Decimal("0.91"), Decimal("0.28"))
WHOLE = (3, 1, 4, 1, 2, 4, 2, 1, 3, 2)


@query(f"SELECT l_returnflag, l_linestatus, CAST(sum({_X} * {_X} * {_X} // 100) AS BIGINT) AS cubes_e4 FROM lineitem GROUP BY 1, 2")
def arithmetic1(spark, sf_dir):
    """Sums of x**3, cut to four fraction digits after each product."""
    x = F.col("l_discount")
    cube = N.trunc_decimal(N.trunc_decimal(x * x, 4, 18) * x, 4, 18)
    return A.group_by(table(spark, sf_dir, "lineitem"), A.keep("l_returnflag"), A.keep("l_linestatus"), ("agg", (F.sum(cube) * 10000).cast("long"), "cubes_e4"))


def _horner_sql() -> str:
    out = f"{int(COEFFICIENTS[0] * 100)} * {_X}"
    for c in COEFFICIENTS[1:]:
        out = f"(({out} + {int(c * 100)} * 100) * {_X}) // 100"
    return out


@query(f"SELECT l_returnflag, l_linestatus, CAST(sum({_horner_sql()}) AS BIGINT) AS total_e4 FROM lineitem GROUP BY 1, 2")
def arithmetic2(spark, sf_dir):
    """A polynomial of rank 6, cut to four fraction digits after each product."""
    x, total = F.col("l_discount"), None
    for c in COEFFICIENTS:
        a = F.lit(c).cast("decimal(4,2)")
        total = N.trunc_decimal((a if total is None else total + a) * x, 4, 18)
    return A.group_by(table(spark, sf_dir, "lineitem"), A.keep("l_returnflag"), A.keep("l_linestatus"), ("agg", (F.sum(total) * 10000).cast("long"), "total_e4"))


def _whole_sql() -> str:
    out = str(WHOLE[0])
    for c in WHOLE[1:]:
        out = f"({out} * CAST(l_linenumber AS BIGINT) + {c})"
    return out


@query(f"SELECT l_returnflag, l_linestatus, min({_whole_sql()}) AS least FROM lineitem GROUP BY 1, 2")
def arithmetic3(spark, sf_dir):
    total = N.polynomial(F.col("l_linenumber").cast("long"), [F.lit(c).cast("long") for c in WHOLE])
    return A.group_by(table(spark, sf_dir, "lineitem"), A.keep("l_returnflag"), A.keep("l_linestatus"), A.min_of(total, "least"))


@query("SELECT l_returnflag, l_linestatus, min(CAST(l_linenumber AS BIGINT) * l_linenumber * l_linenumber * l_linenumber) AS least FROM lineitem GROUP BY 1, 2")
def arithmetic4(spark, sf_dir):
    n = F.col("l_linenumber").cast("long")
    return A.group_by(table(spark, sf_dir, "lineitem"), A.keep("l_returnflag"), A.keep("l_linestatus"), A.min_of(n * n * n * n, "least"))


# Aggregates


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark, sf_dir):
    return A.group_by(table(spark, sf_dir, "lineitem"), A.count_all("n"))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def sum_global(spark, sf_dir):
    return A.group_by(table(spark, sf_dir, "lineitem"), A.sum_of(F.col("l_linenumber"), "total"))


@query("SELECT CAST(CAST(CAST(sum(l_linenumber) AS HUGEINT) * 10000 // count(*) AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4)) AS mean FROM lineitem")
def avg_global(spark, sf_dir):
    return A.group_by(table(spark, sf_dir, "lineitem"), A.avg_of(F.col("l_linenumber"), "mean"))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(CAST(CAST(sum(l_linenumber) AS HUGEINT) * 10000 // count(*) AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4)) AS mean FROM lineitem")
def agg_multi(spark, sf_dir):
    x = F.col("l_linenumber")
    return A.group_by(table(spark, sf_dir, "lineitem"), A.count_all("n"), A.sum_of(x, "total"), A.avg_of(x, "mean"))


@query("SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1")
def group_count(spark, sf_dir):
    return A.group_by(table(spark, sf_dir, "lineitem"), A.keep("l_linenumber"), A.count_all("n"))


@query(f"SELECT c_nationkey, min({m('c_acctbal')}) AS least FROM customer GROUP BY 1")
def min_group(spark, sf_dir):
    return A.group_by(table(spark, sf_dir, "customer"), A.keep("c_nationkey"), A.min_of(F.col("c_acctbal"), "least"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def keep_only(spark, sf_dir):
    return A.group_by(table(spark, sf_dir, "orders"), A.keep("o_orderstatus"), A.keep("o_orderpriority"))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem WHERE l_linenumber < 0")
def agg_empty(spark, sf_dir):
    """Over no rows: one row, a count of 0 and a null sum."""
    return A.group_by(A.select(table(spark, sf_dir, "lineitem"), F.col("l_linenumber") < 0), A.count_all("n"), A.sum_of(F.col("l_linenumber"), "total"))


@query("SELECT l_returnflag, CASE WHEN count(*) = count(x) THEN CAST(sum(x) AS BIGINT) END AS strict, CAST(sum(x) AS BIGINT) AS plain FROM (SELECT l_returnflag, CASE WHEN l_returnflag <> 'R' OR l_linenumber <> 3 THEN l_linenumber END AS x FROM lineitem) GROUP BY 1")
def strict_null_sum(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("x", F.when((F.col("l_returnflag") != "R") | (F.col("l_linenumber") != 3), F.col("l_linenumber")))
    return A.group_by(li, A.keep("l_returnflag"), ("agg", N.strict_null_sum(F.col("x")).cast("long"), "strict"), ("agg", F.sum("x"), "plain"))


@query("SELECT sum(CAST(l_orderkey + l_partkey + l_suppkey AS BIGINT))::BIGINT AS total, count(*) AS n FROM lineitem")
def tuple_sum(spark, sf_dir):
    return A.group_by(table(spark, sf_dir, "lineitem"), A.sum_of(F.col("l_orderkey") + F.col("l_partkey") + F.col("l_suppkey"), "total"), A.count_all("n"))


# Projection, filters, predicates


@query(f"SELECT c_custkey, c_name, {m('c_acctbal')} AS c_acctbal FROM customer")
def select_project(spark, sf_dir):
    return A.project(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_acctbal")


@query("SELECT * FROM nation")
def select_star(spark, sf_dir):
    return A.project(table(spark, sf_dir, "nation"), "*")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def select_eq(spark, sf_dir):
    return A.project(A.select(table(spark, sf_dir, "customer"), F.col("c_mktsegment") == "BUILDING"), "c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def select_and(spark, sf_dir):
    return A.project(A.select(table(spark, sf_dir, "customer"), F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") == 7), "c_custkey")


def _comparison(name, mode, sql_mode):
    @query(f"SELECT o_orderkey FROM orders WHERE {d('o_orderdate')} {sql_mode} DATE '1996-06-15' AND {m('o_totalprice')} {sql_mode} CAST(150000 AS DECIMAL(15,2))")
    def run(spark, sf_dir):
        o = table(spark, sf_dir, "orders")
        return A.project(A.select(o, A.compare(mode, F.col("o_orderdate"), F.lit("1996-06-15").cast("date")), A.compare(mode, F.col("o_totalprice"), F.lit(150000).cast("decimal(15,2)"))), "o_orderkey")

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _name, _mode in (("cmp_lt", "<"), ("cmp_leq", "<="), ("cmp_geq", ">="), ("cmp_gtr", ">")):
    _comparison(_name, _mode, _mode)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber = 1 OR l_returnflag = 'R') AND NOT l_linestatus = 'O'")
def bool_and_or_not(spark, sf_dir):
    c = A.conjunction(A.disjunction(F.col("l_linenumber") == 1, F.col("l_returnflag") == "R"), A.negation(F.col("l_linestatus") == "O"))
    return A.project(A.select(table(spark, sf_dir, "lineitem"), c), "l_orderkey", "l_linenumber")


_LOGIC = "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey % 3 = 1 END AS a, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey % 2 = 0 END AS b FROM customer"


@query(f"SELECT c_custkey, a AND b AS conj, a OR b AS disj, NOT a AS neg, a IS NULL AS unknown FROM ({_LOGIC})")
def null_logic(spark, sf_dir):
    n = F.col("c_nationkey")
    a, b = F.when(n % 3 != 0, n % 3 == 1), F.when(n % 5 != 0, n % 2 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", (a & b).alias("conj"), (a | b).alias("disj"), (~a).alias("neg"), a.isNull().alias("unknown"))


@query(f"SELECT c_custkey FROM ({_LOGIC}) WHERE a AND b")
def null_filter(spark, sf_dir):
    """Only true passes; null doesn't."""
    n = F.col("c_nationkey")
    c = table(spark, sf_dir, "customer")
    return A.select(c, F.when(n % 3 != 0, n % 3 == 1) & F.when(n % 5 != 0, n % 2 == 0)).select("c_custkey")


@query(f"SELECT l_orderkey, l_linenumber, CAST({m('l_extendedprice')} * (1 - {m('l_discount')}) AS DECIMAL(38,4)) AS disc_price FROM lineitem")
def map_expr(spark, sf_dir):
    out = A.map_columns(table(spark, sf_dir, "lineitem"), disc_price=dec(F.col("l_extendedprice") * (F.lit(1).cast("decimal(15,2)") - F.col("l_discount"))))
    return out.select("l_orderkey", "l_linenumber", "disc_price")


# Joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_two(spark, sf_dir):
    return A.join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")], strict=True).select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, x.n FROM lineitem JOIN (SELECT l_orderkey AS k, l_linenumber AS j, count(*) AS n FROM lineitem GROUP BY 1, 2) x ON l_orderkey = k AND l_linenumber = j")
def join_multi_key(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x = li.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return A.join(li, x, [("l_orderkey", "k"), ("l_linenumber", "j")]).select("l_orderkey", "l_linenumber", "n")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_three(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return A.join(A.join(c, n, [("c_nationkey", "n_nationkey")]), r, [("n_regionkey", "r_regionkey")]).select("c_custkey", "n_name", "r_name")


@query("SELECT n_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_four(spark, sf_dir):
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = A.join(A.join(A.join(li, o, [("l_orderkey", "o_orderkey")]), c, [("o_custkey", "c_custkey")]), n, [("c_nationkey", "n_nationkey")])
    return A.group_by(j, A.keep("n_name"), A.count_all("n"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("x")), n.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("y"))
    return A.join(a, b, [("x", "y")]).select("a", "b")


@query("SELECT c_custkey, s_suppkey FROM customer, supplier, nation WHERE c_nationkey = n_nationkey AND s_nationkey = n_nationkey AND c_nationkey = s_nationkey")
def join_cycle(spark, sf_dir):
    """Three conditions in a circle: all of them apply. Every pair of a nation is a row."""
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    circle = A.join(c, n, [("c_nationkey", "n_nationkey")]).select("c_custkey", "c_nationkey", "n_nationkey")
    j = A.join_pairs(circle, s.select("s_suppkey", F.col("s_nationkey").alias("x"), F.col("s_nationkey").alias("y")), [("n_nationkey", "x"), ("c_nationkey", "y")])
    return j.select("c_custkey", "s_suppkey")


@query("SELECT o_orderkey, n_name FROM orders JOIN nation ON o_custkey % 25 = n_nationkey")
def join_expression(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    return A.join(o, n, [(F.col("o_custkey") % 25, F.col("n_nationkey"))]).select("o_orderkey", "n_name")


@query("SELECT r_name, n_name FROM region, nation")
def join_unconnected(spark, sf_dir):
    return A.cross(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")).select("r_name", "n_name")


LEFT = [("left1", 1, 6), ("left2", 2, 7), ("left3", 2, 7), ("left4", 3, 8), ("left5", 4, 9), ("left6", 5, 10), ("left7", 12, 12), ("left8", 13, 13), ("left9", 12, 12)]
RIGHT = [("right1", 1, 6), ("right2", 2, 7), ("right3", 2, 7), ("right4", 3, 8), ("right5", 3, 8), ("right6", 5, 11)]


def _values(rows) -> str:
    return ", ".join(f"('{a}', {b}, {c})" for a, b, c in rows)


@query(f"SELECT l.a AS l, r.a AS r FROM (VALUES {_values(LEFT)}) l(a, b, c) JOIN (VALUES {_values(RIGHT)}) r(a, b, c) ON l.b = r.b AND l.c = r.c")
def join_multiplicity(spark, sf_dir):
    left, right = spark.createDataFrame(LEFT, "l string, b int, c int"), spark.createDataFrame(RIGHT, "r string, d int, e int")
    return A.join(left, right, [("b", "d"), ("c", "e")], strict=True).select("l", "r")


@query(f"SELECT o_orderkey FROM orders JOIN (SELECT c_custkey FROM customer WHERE c_custkey < 0) ON o_custkey = c_custkey")
def join_empty(spark, sf_dir):
    nobody = A.select(table(spark, sf_dir, "customer"), F.col("c_custkey") < 0)
    return A.join(table(spark, sf_dir, "orders"), nobody, [("o_custkey", "c_custkey")]).select("o_orderkey")


_SUMMAND = f"CAST({m('l_extendedprice')} * CAST(floor(log2((l_discount + 1.0) * 2.0)) AS BIGINT) AS DECIMAL(38,2))"


@query(f"SELECT CAST(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_SUMMAND} ELSE 0 END) / sum({_SUMMAND}) AS BIGINT) AS dummy, CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_SUMMAND} ELSE 0 END) AS DECIMAL(38,2)) AS promo, CAST(sum({_SUMMAND}) AS DECIMAL(38,2)) AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {d('l_shipdate')} >= DATE '1995-09-01' AND {d('l_shipdate')} < DATE '1995-10-01'".replace("CAST(100 * sum", "CAST(floor(100 * sum").replace(" AS BIGINT) AS dummy", ") AS BIGINT) AS share"))
def promo_q14(spark, sf_dir):
    """The promotion share of a month's revenue, in whole percent."""
    li = A.select(table(spark, sf_dir, "lineitem"), F.col("l_shipdate") >= F.lit("1995-09-01").cast("date"), F.col("l_shipdate") < F.lit("1995-10-01").cast("date"))
    j = A.join(li, table(spark, sf_dir, "part"), [("l_partkey", "p_partkey")])
    summand = (F.col("l_extendedprice") * N.log_bucket(F.col("l_discount"), F.lit(2)).cast("decimal(5,0)")).cast("decimal(20,2)")
    promo = F.when(F.col("p_type").startswith("PROMO"), summand).otherwise(F.lit(0).cast("decimal(20,2)"))
    sums = j.agg(F.sum(promo).alias("p"), F.sum(summand).alias("t"))
    return sums.select(F.floor(F.lit(100) * F.col("p") / F.col("t")).cast("long").alias("share"), dec(F.col("p"), 2).alias("promo"), dec(F.col("t"), 2).alias("total"))


# Casts and division


@query(f"SELECT p_partkey, CAST(p_size AS DECIMAL(18,4)) AS as_numeric FROM part")
def cast_int_numeric(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.int_to_numeric(F.col("p_size")).alias("as_numeric"))


@query(f"SELECT c_custkey, CAST(trunc(c_acctbal) AS INTEGER) AS whole, CAST(trunc(round(c_acctbal * 100) / 10) / 10 AS DECIMAL(18,1)) AS tenths FROM customer")
def cast_numeric_int(spark, sf_dir):
    """Digits are cut off, not rounded, also of negative numbers."""
    c = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", N.numeric_to_int(c).alias("whole"), N.trunc_decimal(c, 1, 18).alias("tenths"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey // l_linenumber AS BIGINT) AS quotient FROM lineitem")
def div_int(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.int_div(F.col("l_partkey"), F.col("l_linenumber")).alias("quotient"))


@query("SELECT l_orderkey, l_linenumber, CAST((CAST(round(l_extendedprice * 100) AS BIGINT) * 100) // CAST(round(l_quantity * 100) AS BIGINT) AS BIGINT) AS unit_cents FROM lineitem")
def div_numeric(spark, sf_dir):
    unit = N.numeric_div(F.col("l_extendedprice"), F.col("l_quantity"), 2, 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (unit * 100).cast("long").alias("unit_cents"))


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0.99 AS DECIMAL(38,2)), CAST(-0.99 AS DECIMAL(38,2)), CAST(1.6666 AS DECIMAL(18,4)))) v(near_one, cut, cut_negative, mean)")
def div_extremes(spark, sf_dir):
    """Quotients just under one are cut off, whatever their size, and an average is."""
    big, a, b = F.lit(9223372036854775807), F.lit(Decimal("9999999999999999.99")), F.lit(Decimal("10000000000000000.00"))
    values = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    return A.group_by(values, ("agg", N.int_div(F.max(big - 1), F.max(big)), "near_one"), ("agg", dec(N.numeric_div(F.max(a), F.max(b), 2, 2), 2), "cut"), ("agg", dec(N.numeric_div(-F.max(a), F.max(b), 2, 2), 2), "cut_negative"), A.avg_of(F.col("x"), "mean"))


# Relations of a version-control schema, and a wiki kept in plain relations


@query("SELECT c_name AS user_name FROM customer, (SELECT c_custkey AS rid, CASE WHEN c_custkey % 2 = 0 THEN 'users' ELSE 'tasks' END AS tableid, c_custkey % 4 AS vid FROM customer) v WHERE c_custkey = rid AND tableid = 'users' AND vid = 2")
def versiontable_join(spark, sf_dir):
    users = table(spark, sf_dir, "customer")
    rid = F.col("c_custkey")
    versions = users.select(rid.alias("rid"), F.when(rid % 2 == 0, "users").otherwise("tasks").alias("tableid"), (rid % 4).alias("vid"))
    return A.join(users, A.select(versions, F.col("tableid") == "users", F.col("vid") == 2), [("c_custkey", "rid")]).select(F.col("c_name").alias("user_name"))


WIKI = {
    "page": "SELECT page_id AS id, url AS title FROM pages",
    "revision": "SELECT doc_id AS id, doc_id AS textid, doc_id % 250 AS pageid, doc_id % 1500 AS userid FROM documents",
    "content": "SELECT doc_id AS id, text FROM documents",
    "user": "SELECT c_custkey AS id, c_name AS name FROM customer",
}


def wiki(spark, sf_dir):
    doc, page, cust = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages", "customer"))
    i = F.col("doc_id")
    return {
        "page": page.select(F.col("page_id").alias("p_id"), F.col("url").alias("title")),
        "revision": doc.select(i.alias("r_id"), i.alias("textid"), (i % 250).alias("pageid"), (i % 1500).alias("userid")),
        "content": doc.select(i.alias("c_id"), "text"),
        "user": cust.select(F.col("c_custkey").alias("u_id"), F.col("c_name").alias("name")),
    }


@query(f"SELECT r.id, title, text FROM ({WIKI['revision']}) r, ({WIKI['content']}) c, ({WIKI['page']}) p WHERE c.id = r.textid AND p.id = r.pageid AND r.pageid = 17")
def wiki_ms_unversioned(spark, sf_dir):
    w = wiki(spark, sf_dir)
    j = A.join(A.join(A.select(w["revision"], F.col("pageid") == 17), w["content"], [("textid", "c_id")]), w["page"], [("pageid", "p_id")])
    return j.select(F.col("r_id").alias("id"), "title", "text")


@query(f"SELECT r.id, name, title, text FROM ({WIKI['revision']}) r, ({WIKI['content']}) c, ({WIKI['page']}) p, ({WIKI['user']}) u WHERE u.id = r.userid AND c.id = r.textid AND p.id = r.pageid")
def wiki_mm_unversioned(spark, sf_dir):
    w = wiki(spark, sf_dir)
    j = A.join(A.join(A.join(w["revision"], w["content"], [("textid", "c_id")]), w["page"], [("pageid", "p_id")]), w["user"], [("userid", "u_id")])
    return j.select(F.col("r_id").alias("id"), "name", "title", "text")


@query("SELECT * FROM (VALUES (2, 2), (6, 1), (8, 2), (12, 1)) v(semester, n)")
def university_semesters(spark, sf_dir):
    return A.group_by(load_university(spark)["studenten"], A.keep("semester"), A.count_all("n"))
