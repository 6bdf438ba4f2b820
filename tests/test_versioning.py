"""Branches against a plain model of liveness bits and version chains."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline import dml
from forkline import versioning as V
from forkline.catalog import Catalog

SCHEMA = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.IntegerType())])


class Model:
    """A bit for each row and branch, and each row's versions, newest first."""

    def __init__(self, early: bool = False):
        self.parent, self.bits, self.chain, self.early = {0: None}, {}, {}, early

    def lineage(self, b):
        out = {}
        while self.parent[b] is not None:
            out[self.parent[b]] = b
            b = self.parent[b]
        return out

    def branch(self, parent):
        n = len(self.parent)
        self.parent[n] = parent
        for bits in self.bits.values():
            if parent in bits:
                bits.add(n)
        return n

    def write(self, k, v, b):
        self.bits.setdefault(k, set()).add(b)
        self.chain.setdefault(k, []).insert(0, (b, len(self.parent) - 1, v))

    def delete(self, k, b):
        self.bits[k].discard(b)

    def seen(self, b):
        line, out = self.lineage(b), {}
        for k, bits in self.bits.items():
            if b in bits:
                ok = [v for w, e, v in self.chain[k] if w == b or w in line and (e <= line[w] if self.early else e < line[w])]
                out[k] = ok
        return out


def play(spark, seed, steps=14):
    r, model, wrong = random.Random(seed), Model(), Model(early=True)
    c = Catalog(spark)
    c.create_table("t", SCHEMA)
    names, n = ["master"], 0
    for _ in range(steps):
        b = r.randrange(len(names))
        live = sorted(model.seen(b))
        what = r.choice(["insert", "insert", "branch", "update", "update", "delete"])
        if what == "branch":
            names.append(f"b{len(names)}")
            c.create_branch(names[-1], names[b])
            for m in (model, wrong):
                m.branch(b)
        elif what == "insert" or not live:
            n += 1
            dml.insert_values(c, "t", {"k": n, "v": 0}, names[b])
            for m in (model, wrong):
                m.write(n, 0, b)
        else:
            k, v = r.choice(live), r.randrange(1, 1000)
            if what == "update":
                dml.update(c, "t", {"v": F.lit(v)}, F.col("k") == k, names[b])
                for m in (model, wrong):
                    m.write(k, v, b)
            else:
                dml.delete(c, "t", F.col("k") == k, names[b])
                for m in (model, wrong):
                    m.delete(k, b)
    return c, names, model, wrong


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_against_the_model(spark, seed):
    c, names, model, _ = play(spark, seed)
    for b, name in enumerate(names):
        seen = model.seen(b)
        assert dict(map(tuple, V.resolve(c, "t", name).collect())) == {k: v[0] for k, v in seen.items()}
        assert dict(map(tuple, V.earliest(c, "t", name).collect())) == {k: v[-1] for k, v in seen.items()}
        assert dict(map(tuple, V.revision(c, "t", 1, name).collect())) == {k: v[1] for k, v in seen.items() if len(v) > 1}


def test_the_model_tells_a_wrong_rule():
    """A child that saw its parent's later writes would be noticed."""
    m, wrong = Model(), Model(early=True)
    for x in (m, wrong):
        x.write(1, 0, 0)
        x.branch(0)
        x.write(1, 7, 0)
    assert m.seen(1) == {1: [0]} and wrong.seen(1) == {1: [7, 0]}


def test_history_leaves_out_later_writes_of_the_parent(spark):
    c = Catalog(spark)
    c.create_table("t", SCHEMA)
    dml.insert_values(c, "t", {"k": 1, "v": 1})
    c.create_branch("b")
    dml.update(c, "t", {"v": F.lit(3)}, None, "b")
    dml.update(c, "t", {"v": F.lit(4)})
    assert [V.revision(c, "t", n, "b").first()["v"] for n in (0, 1)] == [3, 1]
    assert V.history(c, "t", "b").first()["n_versions"] == 2


def test_saved_and_loaded(spark, tmp_path):
    root = (tmp_path / "db").as_uri()
    c = Catalog(spark, root)
    c.create_table("t", SCHEMA)
    dml.insert_values(c, "t", {"k": 1, "v": 1})
    c.create_branch("b")
    dml.update(c, "t", {"v": F.lit(2)}, None, "b")
    again = Catalog.load(spark, root)
    dml.insert_values(again, "t", {"k": 2, "v": 5}, "b")
    assert sorted(map(tuple, V.resolve(again, "t", "b").collect())) == [(1, 2), (2, 5)]
    assert sorted(map(tuple, V.resolve(again, "t").collect())) == [(1, 1)]


def test_rows_of_a_failed_statement_dont_count(spark):
    c = Catalog(spark)
    t = c.create_table("t", SCHEMA)
    dml.insert_values(c, "t", {"k": 1, "v": 1})
    bad = spark.range(3).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).cast("int").alias("v"))
    with pytest.raises(Exception):
        dml.insert(c, "t", bad)
    assert t.base_note["orphans"]
    assert V.resolve(c, "t").collect() == [(1, 1)]


def test_a_table_made_after_branches_and_a_dropped_one(spark):
    c = Catalog(spark)
    c.create_branch("b")
    c.create_table("t", SCHEMA)
    dml.insert_values(c, "t", {"k": 1, "v": 1}, "b")
    assert V.resolve(c, "t").count() == 0 and V.resolve(c, "t", "b").count() == 1
    tid = V.resolve(c, "t", "b", with_tid=True).first()["_tid"]
    assert V.is_visible(c, "t", tid, "b") and not V.is_visible(c, "t", tid)
    c.drop_table("t")
    c.create_table("t", SCHEMA)
    assert V.resolve(c, "t", "b").count() == 0
    assert c.graph(counts=True)["nodes"][0] == {"name": "master", "id": 0, "tuples": 0}


def test_unchanged_branches_are_plain_scans(spark, data):
    c = Catalog(spark)
    c.register("customer", spark.read.parquet(f"{data}/customer.parquet"), "c_custkey")
    c.create_branch("b")
    plan = V.resolve(c, "customer", "b").where("c_nationkey = 3")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "EqualTo(c_nationkey,3)" in plan
