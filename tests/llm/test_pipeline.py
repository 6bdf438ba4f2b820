"""The registered queries against SQL, and the pipeline against its parts by brute force."""

import numpy as np
import pytest

import corpus_pipeline
from forkline.llm import decontaminate as D
from forkline.llm import language_id as L
from forkline.llm import queries
from forkline.llm.common import Words, windows
from forkline.llm.ngram_join import gram_set


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)] + ["pipeline"]


def test_pipeline(spark, data):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    model = L.train(spark.read.parquet(f"{data}/documents.parquet"))
    told = {r["doc_id"]: r["ambiguous"] for r in L.identify(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), model).collect()}
    kept = {i: t for i, t in rows.items() if not told[i]}
    first = {}
    for i in sorted(kept):
        first.setdefault(kept[i], i)
    kept = {i: t for t, i in first.items()}
    words, sets, root = Words(), [], {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(kept):
        s = gram_set(words(kept[i]))
        for j, u in sets:
            o = len(np.intersect1d(s, u))
            if len(s) and o >= 0.5 * (len(s) + len(u) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        sets.append((i, s))
    kept = {i: t for i, t in kept.items() if find(i) == i}
    items = [words(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]

    def leaks(w, item):
        """Every diagonal, if there is one at all with three equal words in a row: four of five equal can't do without."""
        return len(np.intersect1d(windows(w, 3, 1), windows(item, 3, 1))) and any(D.overlap(w, item, shift) for shift in range(-len(item) + 1, len(w)))

    clean = {i for i, t in kept.items() if not any(leaks(words(t), x) for x in items)}
    out = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in out} == clean
    assert all(r["text"] == rows[r["doc_id"]] and r["round_trip"] for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "decontamination", "bpe_encoding"]


def test_stages_keep_odd_rows(spark, docs, odd_rows, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = docs(odd_rows, clashing=True)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, df, str(tmp_path))
        if name != "bpe_encoding":
            assert out.columns == df.columns
        n = len(odd_rows) - (name == "exact_dedup")
        assert out.count() == n, name


def test_pipeline_over_an_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some words of a test")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, "a text without a label", None, "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]])
def test_language_stage_without_labelled_rows(spark, docs, rows):
    df = docs(rows)
    out = L.identify(df, L.train(df)).collect()
    assert sorted((r["doc_id"], r["language"], r["margin"], r["ambiguous"]) for r in out) == [(i, None, None, True) for i, *_ in rows]
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, df, None)
    assert kept.columns == df.columns and kept.count() == 0
