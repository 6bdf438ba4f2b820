"""Jaccard self-join of word n-gram sets by prefix trees, exact.

One order of all n-grams, by document frequency and then by hash, holds for the whole
table. Two sets that reach the threshold share an n-gram among the first of either (its
prefix), so only sets that share one are ever compared. Their n-grams are put, the frequent
first, into a trie whose nodes hold whole runs. A probe walks the trie once: sets below a
node share the overlap counted so far, and a subtree is left as soon as what remains, of
the probe or of the longest set below, can't reach the threshold.

Frequencies: the n-grams of some documents at a time travel as packed arrays to the bucket
of their hash, and those that repeat travel back. An n-gram in no other document can't be
shared, so it counts for its set's size only, and a set that is left with too few
others to reach the threshold needs no comparison at all.

Blocks: equal sets are first collapsed to one. Each prefix n-gram links the sets that have
it; a set goes to the block of the smallest set it is linked to, a block with many sets is
cut into parts, and each two parts that an n-gram links meet in one task. So no task holds
more than two parts, however large a family of copies is, and each pair is met once.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, id_longs, ship, sliced, text_bytes, windows, words_of_worker, written

N, THRESHOLD = 3, 0.5
#: Sets in one part of a block.
PART = 1000
#: Packed n-grams for one bucket, about, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 1 << 20
#: N-grams and documents that are packed together at most (a longer document is alone).
PACK_GRAMS, PACK_DOCS = 1 << 19, 60_000
#: An n-gram in more of the documents packed together sends its bucket their number only.
HOT = 64
#: Stands for all documents packed together that have a hot n-gram.
ALL = 0xFFFF


def gram_set(words: np.ndarray, n: int = N, seed: int = 11) -> np.ndarray:
    """The sorted distinct n-gram hashes, 64 bits each; a text of fewer words is one gram."""
    if 0 < len(words) < n:
        words, n = words, len(words)
    return np.unique(windows(words, n, seed))


def frequency_class(df: np.ndarray) -> np.ndarray:
    """A byte that doesn't fall as the frequency grows: itself up to 64, then eighths of octaves."""
    high = 64 + np.floor(8 * np.log2(np.maximum(df, 64) / 64)).astype(np.int64)
    return np.minimum(np.where(df <= 64, df, high), 255).astype(np.uint8)


class Trie:
    """Sets of small integers, each sorted, as a trie of runs. Sizes may count members that
    are in no other set and so aren't listed."""

    __slots__ = ("runs", "below", "leaves", "depth", "deepest", "shortest", "longest", "first")

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        """`sets` in lexicographic order. first: the smallest index of a set below a node."""
        self.runs, self.below, self.leaves, self.depth, self.deepest, self.shortest, self.longest, self.first = ([] for _ in self.__slots__)
        root = self._node(np.empty(0, np.int64), 0, 0)
        path, before = [root], None
        for i, s in enumerate(sets):
            shared = 0
            if before is not None:
                m = min(len(s), len(before))
                differ = np.flatnonzero(s[:m] != before[:m])
                shared = int(differ[0]) if len(differ) else m
            while self.depth[path[-1]] > shared:
                node = path.pop()
                top = self.depth[path[-1]]
                if top < shared:  # the run parts here
                    middle = self._node(self.runs[node][: shared - top], shared, self.first[node])
                    self.runs[node] = self.runs[node][shared - top :]
                    self.below[path[-1]][-1] = middle
                    self.below[middle].append(node)
                    path.append(middle)
                    break
            if len(s) > self.depth[path[-1]]:
                node = self._node(s[self.depth[path[-1]] :], len(s), i)
                self.below[path[-1]].append(node)
                path.append(node)
            self.leaves[path[-1]].append(i)
            before = s
        for node in self._upwards(root):
            of = [sizes[i] for i in self.leaves[node]]
            self.shortest[node] = min(of + [self.shortest[c] for c in self.below[node]], default=0)
            self.longest[node] = max(of + [self.longest[c] for c in self.below[node]], default=0)
            self.deepest[node] = max([self.depth[node], *(self.deepest[c] for c in self.below[node])])

    def _node(self, run: np.ndarray, depth: int, first: int) -> int:
        for column, value in zip((self.runs, self.below, self.leaves, self.depth, self.deepest, self.shortest, self.longest, self.first), (run, [], [], depth, depth, 0, 0, first)):
            column.append(value)
        return len(self.runs) - 1

    def _upwards(self, root: int) -> list[int]:
        order = [root]
        for node in order:
            order.extend(self.below[node])
        return order[::-1]

    def probe(self, s: np.ndarray, n: int, sizes: list[int], mark: np.ndarray, threshold: float, upto: int) -> list[tuple[int, int]]:
        """(index, overlap) of the sets before `upto` that reach the threshold with s, whose
        size is n; `mark` is true at the members of s."""
        found = []
        least, most = threshold * n - 1e-9, n / threshold + 1e-9
        share = threshold / (1 + threshold)
        stack = [(0, 0)]
        while stack:
            node, overlap = stack.pop()
            if self.first[node] >= upto or self.longest[node] < least or self.shortest[node] > most:
                continue
            run, rest = self.runs[node], len(s)
            if len(run):
                overlap += int(np.count_nonzero(mark[run]))
                rest -= int(s.searchsorted(run[-1], "right"))
            if overlap + min(rest, self.deepest[node] - self.depth[node]) < share * (n + max(self.shortest[node], least)) - 1e-9:
                continue
            for i in self.leaves[node]:
                if i < upto and overlap >= threshold * (n + sizes[i] - overlap) - 1e-9:
                    found.append((i, overlap))
            stack.extend((c, overlap) for c in self.below[node])
        return found


def trie_join(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None, sizes: list[int] | None = None, classes: list[np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(i, j, overlap) of all pairs of the sets that reach the threshold; with `side` only
    pairs of different sides. Empty sets pair with nothing. `sizes`: the sets' sizes where
    members that no other set has are left out; `classes`: each member's frequency class
    (by default the members' frequencies here)."""
    sizes = [len(s) for s in sets] if sizes is None else sizes
    full = [i for i, s in enumerate(sets) if len(s)]
    if len(full) < 2:
        return []
    flat = np.concatenate([sets[i] for i in full])
    grams, at, inverse, counts = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    often = counts if classes is None else np.concatenate([classes[i] for i in full])[at].astype(np.int64)
    place = np.empty(len(grams), np.int64)
    place[np.lexsort((grams, -often))] = np.arange(len(grams))  # the one order, the frequent first
    ranks = place[inverse]
    cuts = np.cumsum([len(sets[i]) for i in full])[:-1]
    own = [np.sort(r) for r in np.split(ranks, cuts)]
    order = sorted(range(len(full)), key=lambda k: own[k].astype(">u4").tobytes())
    own, names = [own[k] for k in order], [full[k] for k in order]
    n = [sizes[k] for k in names]
    left = [k for k in range(len(own)) if side is None or not side[names[k]]]
    kept = [n[k] for k in left]
    trie, mark, out = Trie([own[k] for k in left], kept), np.zeros(len(grams), bool), []
    for k, s in enumerate(own):
        if side is None or side[names[k]]:
            mark[s] = True
            out += [(names[left[j]], names[k], o) for j, o in trie.probe(s, n[k], kept, mark, threshold, k if side is None else len(left))]
            mark[s] = False
    return out


_SENT = "bucket int, pack long, kind int, a binary, b binary, c binary"
#: Kinds of rows: n-grams of single documents, hot n-grams with their number, both in a
#: bucket; then what goes straight to the documents: their ids and sizes, and who has the hot.
SINGLE, NUMBER, DOCS, OWNERS = range(4)


def _keys(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram, and all that is kept of it: as many top bits as name the
    bucket (16 at most) and the low 48."""
    top = min(bits, 16)
    low = grams & np.uint64((1 << 48) - 1)
    if not bits:
        return np.zeros(len(grams), np.int64), low
    return (grams >> np.uint64(64 - bits)).astype(np.int64), (grams >> np.uint64(64 - top) << np.uint64(48)) | low


def _scatter(n: int, bits: int, seed: int, hot_from: int, most: int):
    def packed(part, seq, rows):
        ids, hashes, sets = zip(*rows)
        pack = part << 24 | seq
        sizes = np.array([len(s) for s in sets], np.int64)
        bucket, key = _keys(np.concatenate(sets), bits)
        at = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(key, kind="stable")
        bucket, key, at = bucket[order], key[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        runs = np.diff(np.concatenate([starts, [len(key)]]))
        hot = np.repeat(runs > hot_from, runs)
        digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), seed), np.int64) for s in sets])
        about = np.concatenate([np.array(ids, np.int64), np.array(hashes, np.int64), digests[:, 0], digests[:, 1]])
        home = pack * 0x9E3779B1 % (1 << bits)
        out = [(home, pack, DOCS, about.tobytes(), sizes.astype(np.uint32).tobytes(), b"")]
        if hot.any():
            out.append((home, pack, OWNERS, key[hot].tobytes(), at[hot].tobytes(), b""))
        firsts = starts[runs > hot_from]
        for kind, b, k, value in ((SINGLE, bucket[~hot], key[~hot], at[~hot]), (NUMBER, bucket[firsts], key[firsts], runs[runs > hot_from].astype(np.uint32))):
            low, high = k.astype(np.uint32), (k >> np.uint64(32)).astype(np.uint16)
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.empty(0, np.int64)
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(b)]):
                out.append((int(b[s]), pack, kind, low[s:e].tobytes(), value[s:e].tobytes(), high[s:e].tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
        for k in range(0, len(out), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 1024]), kinds)], ["bucket", "pack", "kind", "a", "b", "c"])

    def run(batches):
        from pyspark import TaskContext

        words, part, seq, rows, total = words_of_worker(), TaskContext.get().partitionId(), 0, [], 0
        for b in sliced(batches):
            for i, h, t in zip(*(c.to_pylist() for c in b.columns)):
                g = gram_set(words(t), n)
                if not len(g):
                    continue
                if rows and (total + len(g) > most or len(rows) == PACK_DOCS):
                    yield from packed(part, seq, rows)
                    rows, total, seq = [], 0, seq + 1
                rows.append((i, h, g))
                total += len(g)
        if rows:
            yield from packed(part, seq, rows)

    return run


_BACK = "pack long, kind int, a binary, b binary, c binary"


def _count_of(bits: int):
    """A bucket's n-grams that repeat, back to the documents with their frequency classes."""

    def run(table: pa.Table) -> pa.Table:
        bucket, packs, kinds, a, b, c = (table.column(k).to_pylist() for k in ("bucket", "pack", "kind", "a", "b", "c"))
        out = [(p, k, x, y, b"") for p, k, x, y in zip(packs, kinds, a, b) if k >= DOCS]
        rows = [r for r in range(len(kinds)) if kinds[r] in (SINGLE, NUMBER)]
        if rows:
            sizes = [len(a[r]) // 4 for r in rows]
            key = np.frombuffer(b"".join(a[r] for r in rows), np.uint32).astype(np.uint64)
            high = np.frombuffer(b"".join(c[r] for r in rows), np.uint16).astype(np.uint64)
            if bits <= 16:  # else the bits above 48 are the bucket's first 16
                prefix = bucket[rows[0]] << 48
            else:
                prefix = bucket[rows[0]] >> (bits - 16) << 48
            key |= high << np.uint64(32) | np.uint64(prefix)
            at, times = [], []
            for r in rows:
                m = len(a[r]) // 4
                at.append(np.frombuffer(b[r], np.uint16) if kinds[r] == SINGLE else np.full(m, ALL, np.uint16))
                times.append(np.ones(m, np.int64) if kinds[r] == SINGLE else np.frombuffer(b[r], np.uint32).astype(np.int64))
            at, times = np.concatenate(at), np.concatenate(times)
            of = np.repeat(np.arange(len(rows)), sizes)
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            df = np.add.reduceat(times[order], starts)
            runs = np.diff(np.concatenate([starts, [len(key)]]))
            again = np.repeat(df > 1, runs)
            class_ = np.repeat(frequency_class(df), runs)[again]
            order = order[again]
            back = np.argsort(of[order], kind="stable")
            order, class_ = order[back], class_[back]
            cut = np.searchsorted(of[order], np.arange(len(rows) + 1))
            for r, s, e in zip(rows, cut.tolist(), cut[1:].tolist()):
                if e > s:
                    out.append((packs[r], SINGLE, key[order[s:e]].tobytes(), at[order[s:e]].tobytes(), class_[s:e].tobytes()))
        kinds_ = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
        return pa.table([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 5, kinds_)], ["pack", "kind", "a", "b", "c"])

    return run


_SETS = "row long, id long, th long, node long, other long, size int, prefix int, grams array<long>, classes binary"


def _sets_of(threshold: float):
    """The documents packed together, each with its repeated n-grams in the one order, if
    they are enough to reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        pack = table.column("pack")[0].as_py()
        by: dict[int, list] = {SINGLE: [], DOCS: [], OWNERS: []}
        for k, a, b, c in zip(*(table.column(x).to_pylist() for x in ("kind", "a", "b", "c"))):
            by[k].append((a, b, c))
        about = np.frombuffer(by[DOCS][0][0], np.int64).reshape(4, -1)
        sizes = np.frombuffer(by[DOCS][0][1], np.uint32).astype(np.int64)
        key, at, class_ = (np.frombuffer(b"".join(x[k] for x in by[SINGLE]), t) for k, t in enumerate((np.uint64, np.uint16, np.uint8)))
        hot = at == ALL
        if hot.any():
            order = np.argsort(key[hot], kind="stable")
            known, its = key[hot][order], class_[hot][order]
            more, who = (np.frombuffer(b"".join(x[k] for x in by[OWNERS]), t) for k, t in enumerate((np.uint64, np.uint16)))
            key, at = np.concatenate([key[~hot], more]), np.concatenate([at[~hot], who])
            class_ = np.concatenate([class_[~hot], its[np.searchsorted(known, more)]])
        shared = np.bincount(at, minlength=len(sizes))
        need = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
        some = (shared >= need) & (shared > 0)
        keep = some[at]
        key, at, class_ = key[keep], at[keep], class_[keep]
        order = np.lexsort((key, class_, at))
        key, class_ = key[order], class_[order]
        which = np.flatnonzero(some)
        ends = np.concatenate([[0], np.cumsum(shared[which])])
        raw, cut = class_.tobytes(), ends.tolist()
        # Of a set's first size - need + 1 members, those that repeat.
        prefix = np.maximum(shared - np.maximum(need, 1) + 1, 0)[which]
        row = (pack << 16) + which
        columns = [pa.array(row), *(pa.array(about[k][which]) for k in range(4)), pa.array(sizes[which], pa.int32()), pa.array(prefix, pa.int32())]
        grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key.view(np.int64)))
        return pa.table([*columns, grams, pa.array([raw[s:e] for s, e in zip(cut, cut[1:])], pa.binary())], [x.split()[0] for x in _SETS.split(", ")])

    return run


def candidate_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, hot: int = HOT, pack_grams: int = PACK_GRAMS) -> DataFrame:
    """A row for each row of `docs` that may have a partner: its id and text hash, the digest
    of its set in two halves, the set's size, its repeated n-grams in the one order of all,
    and how many of them are in its prefix."""
    d = docs.select(id_longs(docs, id_col).alias("id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("t")).where(F.col("id").isNotNull() & (F.length("t") > 0))
    size = text_bytes(d, "t") * 8 // 7  # a word in seven bytes, eight bytes for each
    bits = (min(MOST_BUCKETS, max(8, size // BUCKET_BYTES)) - 1).bit_length()
    sent = d.mapInArrow(_scatter(n, bits, seed, hot, pack_grams), _SENT)
    back = sent.groupBy("bucket").applyInArrow(_count_of(bits), _BACK)
    return back.groupBy("pack").applyInArrow(_sets_of(threshold), _SETS)


def linked_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", part: int = PART, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, work): members(id, th, node) gives the set of every row that may have
    a partner, nodes(node, row, name, copies) the different sets with the smallest id and the
    number of ids that have each, work the sets of every task of the join."""
    ship(docs.sparkSession)
    for seed in count():
        found = written(candidate_sets(docs, n, threshold, id_col, text_col, seed, **how))
        members = found.select("id", "th", "node")
        each = found.groupBy("node", "id").agg(F.min("row").alias("row"), F.min("other").alias("lo"), F.max("other").alias("hi"))
        nodes = written(each.groupBy("node").agg(F.min("row").alias("row"), F.min("id").alias("name"), F.count(F.lit(1)).alias("copies"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        if nodes.where("lo <> hi").isEmpty():  # no two sets share half a digest
            break
    one = found.join(hinted(nodes.select("row", "copies")), "row")
    keyed = one.select("node", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("k"))
    hubs = written(keyed.groupBy("k").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("k", "hub"))
    linked = written(keyed.join(hinted(hubs), "k"))
    # A set's block is the smallest set that any n-gram links it to, cut into parts by hash.
    label = linked.groupBy("node").agg(F.min("hub").alias("label"))
    parts = label.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(part)).alias("p"))
    home = written(label.join(parts, "label").select("node", F.struct("label", F.pmod(F.xxhash64("node"), F.col("p")).alias("p")).alias("home")))
    placed = linked.join(hinted(home), "node").select("k", "node", "home")
    meets = placed.select("k", F.col("home").alias("other")).distinct()
    within = home.select("node", F.col("home").alias("lo"), F.col("home").alias("hi"), F.lit(False).alias("right"))
    across = meets.groupBy("k").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b").select("k")
    apart = placed.join(hinted(across), "k", "left_semi")  # most n-grams are in one part only
    between = apart.join(meets, "k").where("home <> other").select("node", F.least("home", "other").alias("lo"), F.greatest("home", "other").alias("hi"), (F.col("home") > F.col("other")).alias("right")).distinct()
    tasks = within.unionByName(between)
    tasks = written(tasks.select("node", F.col("lo.label").alias("ll"), F.col("lo.p").alias("lp"), F.col("hi.label").alias("hl"), F.col("hi.p").alias("hp"), "right"))
    sets = one.select("node", "size", "copies", "grams", "classes")
    # Small tasks share a group of about two parts, as each group has a cost of its own.
    groups = tasks.count() // (2 * part) + 1
    work = tasks.withColumn("g", F.pmod(F.xxhash64("ll", "lp", "hl", "hp"), F.lit(groups))).join(sets, "node")
    return members, nodes, work


def _pairs_in(table: pa.Table, threshold: float):
    """For each task of a group: its rows, the pairs among them (by place) and the overlaps."""
    by_task: dict[tuple, list[int]] = {}
    for k, task in enumerate(zip(*(table.column(c).to_pylist() for c in ("ll", "lp", "hl", "hp")))):
        by_task.setdefault(task, []).append(k)
    right, size = table.column("right").to_pylist(), table.column("size").to_pylist()
    grams, classes = table.column("grams"), table.column("classes")
    for (ll, lp, hl, hp), rows in by_task.items():
        sets = [grams[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for k in rows]
        side = None if (ll, lp) == (hl, hp) else np.array([right[k] for k in rows])
        yield rows, trie_join(sets, threshold, side, [size[k] for k in rows], [np.frombuffer(classes[k].as_py(), np.uint8) for k in rows])


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", part: int = PART, **how) -> DataFrame:
    """(doc_a, doc_b, jaccard): every pair of different sets that reaches the threshold, each
    set named by the smallest id that has it, doc_a < doc_b. As many rows as there are such
    pairs: ngram_jaccard_join() gives what grows with the documents only."""
    _, nodes, work = linked_sets(docs, n, threshold, id_col, text_col, part, **how)

    def join(table: pa.Table) -> pa.Table:
        node, size, a, b, j = table.column("node").to_pylist(), table.column("size").to_pylist(), [], [], []
        for rows, pairs in _pairs_in(table, threshold):
            for x, y, o in pairs:
                a.append(node[rows[x]])
                b.append(node[rows[y]])
                j.append(o / (size[rows[x]] + size[rows[y]] - o))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(j, pa.float64())], ["a", "b", "jaccard"])

    pairs = work.groupBy("g").applyInArrow(join, "a long, b long, jaccard double")
    name = nodes.select("node", "name")
    named = pairs.join(name.toDF("a", "na"), "a").join(name.toDF("b", "nb"), "b")
    return named.groupBy(F.least("na", "nb").alias("doc_a"), F.greatest("na", "nb").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))


def _stars(threshold: float):
    """Of each task, for every set with a pair: the first set that it is connected with there,
    and how many documents it is linked with. As many rows as sets, not as pairs."""

    def join(table: pa.Table) -> pa.Table:
        node, copies, out = table.column("node").to_pylist(), table.column("copies").to_pylist(), []
        for rows, pairs in _pairs_in(table, threshold):
            root, links = list(range(len(rows))), [0] * len(rows)

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y, _ in pairs:
                links[x] += copies[rows[y]]
                links[y] += copies[rows[x]]
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
            out += [(node[rows[x]], node[rows[find(x)]], m) for x, m in enumerate(links) if m]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], ["node", "root", "links"])

    return join


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", part: int = PART, **how) -> DataFrame:
    """(id, th, class_id, n_links) of every row with a partner, `th` being xxhash64 of its text."""
    members, nodes, work = linked_sets(docs, n, threshold, id_col, text_col, part, **how)
    stars = written(work.groupBy("g").applyInArrow(_stars(threshold), "node long, root long, links long"))
    links = stars.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("node", "name", "copies").join(links, "node", "left").join(roots, "node", "left")
    known = written(known.select("node", "name", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).where("n_links > 0"))
    named = known.groupBy("root").agg(F.min("name").alias("class_id"))
    return members.distinct().join(hinted(known.join(named, "root").select("node", "class_id", "n_links")), "node").drop("node")


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", part: int = PART, **how) -> DataFrame:
    """(doc_id, class_id, n_links): for every row of `docs` its class and the number of other
    documents that it is linked with.

    Documents are linked if their sets of word n-grams have a Jaccard coefficient of at least
    `threshold`; a text of fewer than n words is one gram. Classes are the connected
    components of all links, named by their smallest id. Links of all sets are counted
    exactly (n-grams are told apart by 56 bits or more of their hashes, sets by 128) and
    without a cap on partners or candidates; documents with equal sets are compared once and
    counted each. similar_pairs() lists the pairs of different sets.

    A row without an id or a word (null, empty, signs only) is linked with nothing: its class
    is its id. Repeated rows are one document; rows with one id and different texts are
    linked each by its own text. Ids must be whole numbers (common.id_longs). An empty table gives an empty result. The order of rows within an input
    partition should be repeatable, as that of files is; write the result of a shuffle first.
    """
    found = classes(docs, n, threshold, id_col, text_col, part, **how)
    rows = docs.select(id_longs(docs, id_col).alias("id"), F.xxhash64(docs[text_col]).alias("th"))
    joined = rows.join(found, ["id", "th"], "left")
    return joined.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each is connected with, by turns of linking every
    node's larger neighbours, then its smaller ones, to its smallest; `edges` has longs a, b.
    The edges of each turn are written to the shared folder, so lineage stays short."""
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def total(e):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    state = total(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small_ = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = written(small_.where("u <> v").distinct())
        now = total(links)
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_dedup(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", part: int = PART, **how) -> DataFrame:
    """One document of each class of ngram_jaccard_join(), with its columns: the one with the
    smallest id stays (of equal rows with that id, all). Rows without an id or without a word
    stay, as does everything in an empty table."""
    found = classes(docs, n, threshold, id_col, text_col, part, **how)
    gone = hinted(written(found.where("id <> class_id").select(F.col("id").alias("_gone_id"), F.col("th").alias("_gone_th"))))
    return docs.join(gone, (id_longs(docs, id_col) == gone["_gone_id"]) & (F.xxhash64(docs[text_col]) == gone["_gone_th"]), "left_anti")
