"""Benchmark decontamination by spaced-seed hashing.

A mask is a pattern of positions within a short span; the words at its positions are
hashed and the others ignored, so a substituted word spoils a seed only where the mask
looks. Test and training hashes are joined; around each hit the benchmark item and the
document are laid on one diagonal, and it is verified that a stretch meets the definition
of an overlap, in which some words may differ.

The masks miss no overlap. One of 36 words or more has a shorter one as its part. One of
18 to 35 words has ten successive words of which at most two are substituted, as the whole
of an item of 10 to 14 words has. Those ten are five pairs, of which three are untouched:
PAIRS has each choice of three pairs, but for shifts. Of 15 to 17 words three may be
substituted; if all three are in each ten words, the first and last five are untouched
(ENDS). Of 5 to 9 words one may be substituted, and SHORT leaves out each of the first five.
Of 4 or fewer none may be: WHOLE looks at them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, held, hinted, id_longs, odd_constants, ship, small, text_bytes, words_of_worker, written

#: Positions that each mask looks at, and the least and most words of the items that it is for.
PAIRS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 6, 7), (0, 1, 4, 5, 6, 7), (0, 1, 2, 3, 8, 9), (0, 1, 6, 7, 8, 9), (0, 1, 4, 5, 8, 9))
ENDS = (0, 1, 2, 3, 4, 10, 11, 12, 13, 14)
SHORT = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
WHOLE = ((0,), (0, 1), (0, 1, 2), (0, 1, 2, 3))
MASKS = (*((m, 10, None) for m in PAIRS), (ENDS, 15, 17), *((m, 5, 9) for m in SHORT), *((m, len(m), len(m)) for m in WHOLE))
SPAN = 15

#: A stretch is an overlap if it has so many words (or the whole item, if that is shorter) ...
MIN_WORDS = 18
#: ... of which so many are equal.
MIN_SHARE = 0.8
_STEPS = (1, -4)  # of an equal and a substituted word; a stretch has MIN_SHARE where they sum to 0 or more
#: Where the caller says nothing else, items with fewer words are too common to search for.
MIN_ITEM = 5
#: For the stretch that is reported each equal word adds 1, each substituted one takes so much.
PENALTY = 2.0


#: Positions that are verified, or hits that are listed, at once.
AT_ONCE = 1 << 20


def _seeds(words: np.ndarray, wanted: list[int]) -> list[np.ndarray]:
    """For each wanted mask the hash of every position: sums of words times a constant of the offset."""
    offsets = {k for which in wanted for k in MASKS[which][0]}
    scaled = {k: words * a for k, a in enumerate(odd_constants(SPAN, 77)) if k in offsets}
    out = []
    for which in wanted:
        mask = MASKS[which][0]
        m = len(words) - mask[-1]
        if m <= 0:
            out.append(np.empty(0, np.uint64))
            continue
        total = scaled[mask[0]][mask[0] : mask[0] + m] + np.uint64(which + 1)
        for k in mask[1:]:
            total += scaled[k][k : k + m]
        out.append(total)
    return out


def _own_masks(n: int) -> list[int]:
    """The masks for an item of n words."""
    return [k for k, (_, least, most) in enumerate(MASKS) if n >= least and (most is None or n <= most)]


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the best-scoring stretch of a diagonal; of equal scores the first."""
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -PENALTY))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end


def allowed_stretch(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """Start and end of the stretch of at least `least` words that is most above MIN_SHARE,
    of equal ones the first; None if each is below it."""
    if len(equal) < least:
        return None
    total = np.concatenate([[0], np.cumsum(np.where(equal, *_STEPS))])
    low = np.minimum.accumulate(total[: len(total) - least])
    above = total[least:] - low
    k = int(np.argmax(above))
    if above[k] < 0:
        return None
    return int(np.flatnonzero(total[: k + 1] == low[k])[-1]), k + least


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """(doc start, item start, words, equal words) of the verified stretch on one diagonal:
    the best-scoring one, or if that is no overlap, the one most above MIN_SHARE."""
    first, last = max(0, -shift), min(len(item), len(doc) - shift)
    if last <= first:
        return None
    equal = doc[first + shift : last + shift] == item[first:last]
    least = min(MIN_WORDS, len(item))
    start, end = best_stretch(equal)
    if end - start < least or equal[start:end].sum() < MIN_SHARE * (end - start):
        found = allowed_stretch(equal, least)
        if found is None:
            return None
        start, end = found
    return first + start + shift, first + start, end - start, int(equal[start:end].sum())


class Index:
    """Seeds of all items: a bitmap to pass most positions by, then sorted hashes."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.lengths = np.array([len(w) for _, w in items], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.concatenate([np.empty(0, np.uint64), *(w for _, w in items)])
        own = [_own_masks(len(w)) for _, w in items]
        self.masks = sorted({k for ks in own for k in ks})
        seeds = [dict(zip(ks, _seeds(w, ks))) for (_, w), ks in zip(items, own)]
        self.tables = []
        for which in self.masks:
            some = [(i, s[which]) for i, s in enumerate(seeds) if which in s]
            h = np.concatenate([s for _, s in some])
            order = np.argsort(h, kind="stable")
            owner = np.repeat([i for i, _ in some], [len(s) for _, s in some])[order]
            place = np.concatenate([np.arange(len(s)) for _, s in some])[order]
            bits = max(16, int(len(h)).bit_length() + 5)
            bitmap = np.zeros(1 << bits, bool)
            bitmap[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables.append((h[order], owner, place, bitmap, np.uint64(64 - bits)))

    def search(self, docs: list[np.ndarray]) -> list[tuple]:
        """(which document, item id, doc start, item start, words, equal words): for each
        document and item the best stretch. The documents are hashed as one array; a seed
        over the border of two is none, so what is found doesn't depend on neighbours."""
        if not self.masks or not docs:
            return []
        text, lengths = np.concatenate(docs), np.array([len(d) for d in docs], np.int64)
        borders = np.concatenate([[0], np.cumsum(lengths)])
        diagonals: list[np.ndarray] = []
        for which, s, (h, owner, place, bitmap, drop) in zip(self.masks, _seeds(text, self.masks), self.tables):
            near = np.flatnonzero(bitmap[(s >> drop).astype(np.int64)])
            near = near[near + MASKS[which][0][-1] < borders[np.searchsorted(borders, near, "right")]]
            lo, hi = np.searchsorted(h, s[near], "left"), np.searchsorted(h, s[near], "right")
            near, lo, hi = near[hi > lo], lo[hi > lo], hi[hi > lo]
            for a, b in _slices(hi - lo):
                n = hi[a:b] - lo[a:b]
                k = np.arange(n.sum()) + np.repeat(lo[a:b] - (np.cumsum(n) - n), n)
                at = np.repeat(near[a:b], n)
                d = np.searchsorted(borders, at, "right") - 1
                diagonals.append(self._possible(text, borders, lengths, np.unique(np.stack([d, owner[k], at - borders[d] - place[k]], 1), axis=0)))
        found_ = np.unique(np.concatenate([np.empty((0, 3), np.int64), *diagonals]), axis=0).tolist()
        best: dict[tuple[int, int], tuple] = {}
        for d, i, shift in found_:
            found = overlap(docs[d], self.items[i][1], shift)
            if found and ((d, i) not in best or (-found[3], found[0], found[1]) < (-best[d, i][3], best[d, i][0], best[d, i][1])):
                best[d, i] = found
        return [(d, self.items[i][0], *v) for (d, i), v in sorted(best.items())]

    def _possible(self, text: np.ndarray, borders: np.ndarray, lengths: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
        """Those of the rows (document, item, shift) that have an overlap, as overlap() finds it."""
        d, i, shift = diagonals.T
        first, last = np.maximum(0, -shift), np.minimum(self.lengths[i], lengths[d] - shift)
        least = np.minimum(MIN_WORDS, self.lengths[i])
        keep = np.flatnonzero(last - first >= least)
        good = []
        for a, b in _slices((last - first)[keep] + 1):
            k = keep[a:b]
            n = (last - first)[k]
            ends = np.cumsum(n + 1)  # each with a zero before its first word
            starts, offset = ends - n - 1, np.repeat(np.arange(len(k)), n + 1)
            inner = np.ones(ends[-1], bool)
            inner[starts] = False
            step = np.arange(ends[-1]) - starts[offset] - 1
            at, of = (first[k] + self.starts[i[k]])[offset] + step, (first[k] + shift[k] + borders[d[k]])[offset] + step
            sums = np.zeros(ends[-1], np.int64)
            sums[inner] = np.where(text[of[inner]] == self.flat[at[inner]], *_STEPS)
            sums = np.cumsum(sums)
            sums -= sums[starts][offset]
            fall = -offset * (6 * int(n.max()) + 1)  # so that the minimum begins anew with each
            low = np.minimum.accumulate(sums + fall)
            whole = np.flatnonzero(step + 1 >= least[k][offset])
            ok = sums[whole] + fall[whole] >= low[whole - least[k][offset[whole]]]
            good.append(k[np.unique(offset[whole[ok]])])
        return diagonals[np.concatenate([np.empty(0, np.int64), *good])]


def _slices(sizes: np.ndarray):
    """Runs (start, end) of entries with about AT_ONCE together; a larger one is alone."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield at, stop
        at = stop


def _groups(rows, words: Words, least: int, most: int = 1 << 18):
    """Runs of rows with about `most` words together, as hashed texts; `rows` end with the text."""
    some, arrays, total = [], [], 0
    for row in rows:
        w = words(row[-1])
        if len(w) >= least:
            some.append(row)
            arrays.append(w)
            total += len(w)
        if total >= most:
            yield some, arrays
            some, arrays, total = [], [], 0
    if some:
        yield some, arrays


OUT = "doc_id long, text_hash long, item_id long, doc_start int, item_start int, n_words int, n_equal int"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4]
_NAMES = ["doc_id", "text_hash", "item_id", "doc_start", "item_start", "n_words", "n_equal"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_items: int = 200_000, index_bytes: int = 64 << 20, min_item: int = MIN_ITEM) -> DataFrame:
    """(doc_id, text_hash, item_id, doc_start, item_start, n_words, n_equal): for each row of
    `docs` and each item with a verified overlap, the best one, in words.

    An overlap has MIN_WORDS words (or all of a shorter item's) of which MIN_SHARE are equal.
    Null and empty texts overlap with nothing, on either side; items under `min_item` words
    (1: none) aren't searched for. Rows with a null or repeated id are each reported. Items
    with one id and different texts are each searched for, and may give a row each. Ids are
    whole numbers on both sides; others are refused with a TypeError.

    Up to `index_items` items of `index_bytes` together, both counted, the seeds are sent to
    every task and joined there, in one pass over the documents; above that the two sides'
    seeds are shuffled and joined by hash, and the pairs found are verified after joining
    their texts. Both give the same rows.
    """
    ship(docs.sparkSession)
    text = docs[text_col]
    d = docs.select(id_longs(docs, id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).where(F.length("t") > 0)
    b = benchmark.select(id_longs(benchmark, item_col).alias("item"), benchmark[item_text_col].alias("bt")).where(F.length("bt") > 0).distinct()
    if small(b, index_items) and text_bytes(b, "bt") <= index_bytes:
        rows = [(r["item"], r["bt"]) for r in b.orderBy("item", "bt").toLocalIterator()]
        digest = xxhash.xxh3_128()
        for i, t in rows:
            digest.update(f"{i} {len(t)} {t}".encode("utf-8", "surrogatepass"))
        key = ("overlaps", min_item, digest.hexdigest())

        def make():
            words = Words()
            return words, Index([(i, w) for i, w in ((i, words(t)) for i, t in rows) if len(w) >= min_item])

        def run(batches):
            words, index = held(key, make)  # built once in a worker, not in each task
            for batch in batches:
                for some, arrays in _groups(zip(*(c.to_pylist() for c in batch.columns)), words, min(min_item, MIN_WORDS)):
                    out = [(*some[d][:2], *m) for d, *m in index.search(arrays)]
                    if out:
                        yield _batch(out)

        return d.mapInArrow(run, OUT)

    def of_item(n):
        return _own_masks(n) if n >= min_item else []

    def masks_of(batches):
        words = words_of_worker()
        for batch in batches:
            some = sorted({k for t in batch.column(1).to_pylist() for k in of_item(len(words(t)))})
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32())], ["mask"])

    masks = sorted(r[0] for r in b.mapInArrow(masks_of, "mask int").distinct().collect())  # at most len(MASKS) values

    def seeds_of(is_item):
        def run(batches):
            words = words_of_worker()
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    w = words(t)
                    h = np.unique(np.concatenate([np.empty(0, np.uint64), *_seeds(w, of_item(len(w)) if is_item else masks)]))
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array([t] * len(h), pa.string()) if is_item else pa.array(np.full(len(h), xxh(t), np.int64)), pa.array(h.view(np.int64))], ["k", "h"])

        return run

    def xxh(t):
        return xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)

    def with_key(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([xxh(t) for t in batch.column(2).to_pylist()], pa.int64())], [*batch.schema.names, "k"])

    train = d.select("t").mapInArrow(seeds_of(False), "k long, h long")
    test = b.select("bt").mapInArrow(seeds_of(True), "k string, h long").withColumnRenamed("k", "bt")
    pairs = written(train.join(test, "h").select("k", "bt").distinct())
    keyed = d.mapInArrow(with_key, "id long, th long, t string, k long")
    ready = keyed.join(pairs, "k").join(b, "bt").select("id", "th", "t", "item", "bt")

    def verify(batches):
        words = words_of_worker()
        for batch in batches:
            out = []
            for i, th, t, item, bt in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(i, th, *m) for _, *m in Index([(item, words(bt))]).search([words(t)])]
            if out:
                yield _batch(out)

    return ready.mapInArrow(verify, OUT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs`, with their columns, that overlap with no item (see overlaps(),
    which takes the further parameters). Rows with null or empty text stay, and so do all
    rows if there are no items; an empty table gives an empty one."""
    return drop_rows(docs, overlaps(docs, benchmark, id_col, text_col, **how), id_col, text_col)


def drop_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` without the rows that `found` names by doc_id and text_hash (xxhash64 of the text)."""
    bad = hinted(written(found.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs[text_col]) == bad["_bad_hash"]), "left_anti")
