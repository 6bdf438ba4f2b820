"""Exact dedup, the n-gram join, line dedup and repeated passages against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from forkline.llm import line_dedup, ngram_join, substring_dedup
from forkline.llm.common import Words, normal_word, rolling, windows
from forkline.llm.exact_dedup import exact_dedup
from forkline.llm.ngram_join import components, near_dedup, ngram_jaccard_join, trie_join


def key(r):
    return repr(r)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_exact_dedup(docs, odd_rows, broadcast):
    rows = odd_rows + [(30, "copy"), (20, "copy"), (None, "copy"), (21, "copy "), (40, ""), (41, None), (20, "copy", "fr", "z", 9)]
    df = docs(rows, clashing=True)
    out = exact_dedup(df, broadcast_rows=broadcast, salts=3)
    assert out.columns == [*df.columns, "n_copies_1"]
    got = out.collect()
    groups = Counter(t for _, t, *_ in rows if t is not None)
    assert sorted((r["text"], r["n_copies_1"]) for r in got if r["text"] is not None) == sorted(groups.items())
    assert Counter(r["doc_id"] for r in got if r["text"] is None) == Counter(i for i, t, *_ in rows if t is None)
    least = {t: min((i for i, u, *_ in rows if u == t and i is not None), default=None) for t in groups}
    assert all(r["doc_id"] == least[r["text"]] for r in got if r["text"] is not None)
    assert all(r["n_copies"] == "own n_copies" for r in got)
    assert exact_dedup(docs([]), broadcast_rows=broadcast).count() == 0


def test_a_text_with_many_copies_is_spread(docs):
    out = exact_dedup(docs([(n, "same") for n in range(3000)]).repartition(8)).collect()
    assert [(r["doc_id"], r["n_copies"]) for r in out] == [(0, 3000)]


def jaccard_pairs(rows, n=3, t=0.5):
    """The sets of word n-grams with the ids that have each, and the pairs of sets at t or more."""
    nodes = {}
    for i, text, *_ in rows:
        words = ["".join(c for c in w if c.isalnum()).lower() for w in (text or "").split()]
        words = [w for w in words if w]
        if i is not None and words:
            grams = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}
            nodes.setdefault(frozenset(grams), set()).add(i)
    sets, pairs = list(nodes.items()), {}
    for x, (s, a) in enumerate(sets):
        for u, b in sets[:x]:
            same = len(s & u)
            if same >= t * (len(s) + len(u) - same):
                pairs[s, u] = same / (len(s) + len(u) - same)
    return nodes, pairs


def jaccard_classes(rows, n=3, t=0.5):
    """(class, links) of every row, by brute force."""
    nodes, pairs = jaccard_pairs(rows, n, t)
    links, root = {s: len(v) - 1 for s, v in nodes.items()}, {s: s for s in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        links[a] += len(nodes[b])
        links[b] += len(nodes[a])
        root[find(a)] = find(b)
    least = {}
    for s, v in nodes.items():
        least[find(s)] = min([least.get(find(s), min(v)), *v])
    out = []
    for i, text, *_ in rows:
        own = [s for s, v in jaccard_pairs([(i, text)], n, t)[0].items()]
        out.append((i, least[find(own[0])], links[own[0]]) if own else (i, i, 0))
    return Counter(out)


def family(prose, base, copies, rate, seed):
    r, words = random.Random(seed), prose(120, base)
    return [" ".join(r.choice(prose(50, 5)) if r.random() < rate else w for w in words) for _ in range(copies)]


def test_trie_join_is_exact():
    r = random.Random(3)
    for trial in range(200):
        base = [r.sample(range(60), r.randrange(1, 25)) for _ in range(4)]
        sets = []
        for _ in range(r.randrange(2, 30)):
            s = set(r.choice(base)) | set(r.sample(range(60), r.randrange(4)))
            for _ in range(r.randrange(4)):
                s.discard(r.choice([*s, 0]))
            sets.append(np.array(sorted(s), np.uint32))
        t = r.choice([0.3, 0.5, 0.8, 1.0])
        side = np.array([r.random() < 0.5 for _ in sets]) if trial % 2 else None
        got = {(min(i, j), max(i, j)): o for i, j, o in trie_join(sets, t, side)}
        want = {}
        for j in range(len(sets)):
            for i in range(j):
                o = len(np.intersect1d(sets[i], sets[j]))
                if o and o >= t * (len(sets[i]) + len(sets[j]) - o) - 1e-9 and (side is None or side[i] != side[j]):
                    want[i, j] = o
        assert got == want


def families(prose):
    rows = []
    for k in range(6):
        rows += [(1000 + 100 * k + n, t) for n, t in enumerate(family(prose, k, 12, 0.06, k))]
    rows += [(5000 + n, " ".join(prose(80, 500 + n))) for n in range(60)]
    return rows + [(6000, "one two"), (6001, "One, TWO!"), (6002, "one"), (6003, "one two"), (5, "another text of row five"), (1000, rows[-70][1])]


@pytest.mark.parametrize("part, hot, grams", [(1000, 64, 1 << 20), (5, 3, 700)])
def test_ngram_join(docs, odd_rows, prose, part, hot, grams):
    how = {"part": part, "hot": hot, "pack_grams": grams}
    rows = odd_rows + families(prose)
    df = docs(rows, clashing=True)
    nodes, pairs = jaccard_pairs(rows)
    want = {}
    for (s, u), j in pairs.items():
        a, b = sorted((min(nodes[s]), min(nodes[u])))
        want[a, b] = max(j, want.get((a, b), 0))
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in ngram_join.similar_pairs(df, **how).collect()}
    assert len(want) > 200 and set(got) == set(want)
    assert all(abs(want[p] - j) < 1e-12 for p, j in got.items())
    out = ngram_jaccard_join(df, **how)
    assert out.columns == ["doc_id", "class_id", "n_links"]
    assert Counter(tuple(r) for r in out.collect()) == jaccard_classes(rows)


def test_ngram_join_at_other_thresholds(docs, prose):
    rows = families(prose)
    for t in (0.3, 1.0):
        assert Counter(tuple(r) for r in ngram_jaccard_join(docs(rows), threshold=t).collect()) == jaccard_classes(rows, t=t)


def test_a_hot_ngram_and_many_copies(docs, prose):
    """A line on every document, and a text that a third of them have."""
    line = " ".join(prose(30, 1))
    rows = [(n, line + " " + " ".join(prose(12 if n % 5 else 60, n))) for n in range(200)] + [(1000 + n, "the same text that very many documents have") for n in range(100)]
    assert Counter(tuple(r) for r in ngram_jaccard_join(docs(rows).repartition(7), part=20, hot=4).collect()) == jaccard_classes(rows)


def test_ids_are_whole_numbers(docs):
    with pytest.raises(TypeError, match="whole numbers"):
        ngram_jaccard_join(docs([(1, "a")]).withColumn("doc_id", F.lit("x1")))


def test_near_dedup_keeps_one_of_each_group(docs, odd_rows, prose):
    rows = odd_rows + [(100 + n, t) for n, t in enumerate(family(prose, 1, 8, 0.03, 1))] + [(200 + n, t) for n, t in enumerate(family(prose, 2, 8, 0.03, 2))]
    rows += [(201, "a repeated id with a text of its own")]
    df = docs(rows, clashing=True)
    out = near_dedup(df)
    assert out.columns == df.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == Counter([i for i, *_ in odd_rows] + [100, 200, 201])
    assert near_dedup(docs([])).count() == 0 and ngram_jaccard_join(docs([])).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + n, 1001 + n) for n in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent) if find(x) != x}
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(rows, sites):
    seen = {}
    for _, t, _, s, _ in rows:
        for line in t.split("\n") if t is not None and s is not None else []:
            if line.strip(" "):
                seen.setdefault(line, set()).add(s)
    drop = {k for k, v in seen.items() if len(v) >= sites}
    out = []
    for i, t, *_ in rows:
        parts = [] if t is None else t.split("\n")
        kept = [x for x in parts if x not in drop]
        out.append((i, None if t is None else "\n".join(kept), len(parts) - len(kept)))
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_line_dedup(docs, odd_rows, limit):
    r = random.Random(2)
    common = {f"boilerplate {k}": k for k in range(8, 25)}  # on so many sites
    rows = list(odd_rows)
    for n in range(400):
        site = n % 30
        lines = [f"own line {n}", "", *(x for x, k in common.items() if site < k), "again", "again"][: r.randrange(1, 30)]
        r.shuffle(lines)
        rows.append((1000 + n, "\n".join(lines), "en", f"site{site}", 1))
    rows.append((2000, "boilerplate 24\nboilerplate 24", None, None, None))
    df = docs(rows, clashing=True)
    out = line_dedup.remove_boilerplate(df, min_sites=12, broadcast_lines=limit)
    assert out.columns == [*df.columns, "n_removed_1"]
    assert sorted(((x["doc_id"], x["text"], x["n_removed_1"]) for x in out.collect()), key=key) == sorted(removed(rows, 12), key=key)
    assert line_dedup.remove_boilerplate(docs([]), broadcast_lines=limit).count() == 0


def spans(rows, n=substring_dedup.MIN_WORDS):
    """Every window of n words, compared with every other."""
    where = {}
    for i, t, *_ in rows:
        w = [x for p in (t or "").split() if (x := normal_word(p))] if i is not None else []
        for p in range(len(w) - n + 1):
            where.setdefault(tuple(w[p : p + n]), []).append((i, p))
    marks = {}
    for found in where.values():
        ids = {i for i, _ in found}
        if len(ids) > 1:
            for i, p in found:
                marks[i, i == min(ids), p] = min(ids)
    out, last = [], None
    for (i, own, p), first in sorted(marks.items()):
        if last and last[:2] == (i, own) and p <= last[2] + n:
            out[-1][2], out[-1][4] = p + n, min(out[-1][4], first)
        else:
            out.append([i, p, p + n, 0, first])
        last = (i, own, p)
    return sorted((i, s, e, e - s, f) for i, s, e, _, f in out)


def test_difference_cover():
    v, d = substring_dedup.PERIOD, substring_dedup.COVER
    for i in range(v):
        for j in range(v):
            assert any((i + s) % v in d and (j + s) % v in d for s in range(v))
    assert substring_dedup.ANCHOR + v - 1 == substring_dedup.MIN_WORDS


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_repeated_passages(docs, odd_rows, prose, sent):
    r, rows = random.Random(6), list(odd_rows)
    for n in range(150):
        words = prose(r.randrange(0, 260), 700 + n)
        for _ in range(r.randrange(3)):
            k = r.randrange(8)
            size = [49, 50, 51, 60, 80, 120, 50, 49][k]
            at = r.randrange(len(words) + 1)
            words[at:at] = prose(size, 900 + k)
        rows.append((100 + n, " ".join(words)))
    rows += [(900, rows[-1][1]), (901, "la " * 200), (902, rows[-3][1]), (902, rows[-3][1]), (None, rows[-1][1])]
    df = docs(rows, clashing=True)
    got = sorted(tuple(x) for x in substring_dedup.repeated_passages(df, sent_anchors=sent).collect())
    assert len(got) > 60 and got == spans(rows)
    assert substring_dedup.repeated_passages(docs([]), sent_anchors=sent).count() == 0


def test_window_hashes_tell_windows_apart():
    w = np.random.default_rng(1).integers(1, 50, 3000).astype(np.uint64)
    for f in (windows, rolling):
        h = f(w, 3, 1)
        seen = {}
        for p in range(len(h)):
            assert seen.setdefault(tuple(w[p : p + 3].tolist()), h[p]) == h[p]
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("bits", [0, 3, 16, 20])
def test_keys_keep_all_bits_but_those_between(bits):
    """The bucket and the key together hold a hash's first bits (16 at most) and its last 48."""
    h = np.random.default_rng(bits).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    h = np.concatenate([h, h ^ np.uint64(1), h ^ np.uint64(1 << 47)])
    bucket, key = ngram_join._keys(h, bits)
    assert len(np.unique(key)) == len(np.unique(h)) and (bits > 16 or (bucket == key >> np.uint64(48)).all() or not bits)
    assert bucket.min() >= 0 and bucket.max() < 1 << bits
    if bits >= 16:
        assert (key == h).all()


def test_frequency_classes_never_fall():
    df = np.unique(np.concatenate([np.arange(1, 5000), 1 << np.arange(50)]))
    c = ngram_join.frequency_class(df).astype(int)
    assert (np.diff(c) >= 0).all() and c[0] == 1 and c.max() == 255


def test_exact_dedup_of_rows_with_maps(spark):
    df = spark.sql("SELECT CAST(id % 2 AS BIGINT) AS doc_id, 'same' AS text, map('k', id) AS m, array(struct(map(id, 1) AS n)) AS deep FROM range(6)")
    for limit in (1_000_000, 0):
        got = exact_dedup(df, broadcast_rows=limit).collect()
        assert [(r["doc_id"], r["text"], r["n_copies"]) for r in got] == [(0, "same", 6)]
