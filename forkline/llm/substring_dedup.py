"""Repeated passages by difference-cover anchors.

The residues COVER modulo PERIOD are a difference cover: for any two word positions i and j
there is a shift under PERIOD that brings both onto residues of the cover. So of a passage
of MIN_WORDS words in two documents both have, within its first PERIOD words, an anchor at
the same place of the passage, and hashing the windows at those positions only (one in
five) finds it. Where an anchor repeats, it is extended: every window of MIN_WORDS words
that contains it is looked for in the other documents, and windows that are found
elsewhere are joined to the longest spans.

Hashes travel as packed arrays, a few rows for each bucket of the hash space, and are
sorted there; no text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_longs, plan_bytes, rolling, ship, words_of_worker, written

PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: The shortest passage that is reported.
MIN_WORDS = 50
#: Words of an anchor: so many that an aligned one always fits into the shortest passage.
ANCHOR = MIN_WORDS - PERIOD + 1
#: Packed hashes for one bucket, about.
BUCKET_BYTES = 4 << 20
#: Repeated anchors that are sent to every task; above that the documents get theirs by a join.
SENT_ANCHORS = 4_000_000

_COVERED = np.isin(np.arange(PERIOD), COVER)
_ROW = "bucket int, h binary, id binary, p binary"


def _anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a document."""
    h = rolling(words, ANCHOR, 21)
    at = np.flatnonzero(np.resize(_COVERED, len(h)))
    return at, h[at]


def _packed(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int):
    """Rows of a bucket's hashes, ids and positions; `rows` hold (id, positions, hashes)."""
    if not rows:
        return
    p = np.concatenate([r[1] for r in rows]).astype(np.uint32)
    h = np.concatenate([r[2] for r in rows])
    i = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows])
    bucket = (h >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    p, h, i, bucket = p[order], h[order], i[order], bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    for a in range(0, len(starts), 64):
        cut = [*starts[a : a + 65].tolist()]
        if len(cut) < 65:
            cut.append(len(bucket))
        spans = list(zip(cut, cut[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[[s for s, _ in spans]], pa.int32()), *(pa.array([x[s:e].tobytes() for s, e in spans], pa.binary()) for x in (h, i, p))], ["bucket", "h", "id", "p"])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's hashes, ids and positions, in this order of importance."""
    h, i, p = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("h", np.uint64), ("id", np.int64), ("p", np.uint32)))
    order = np.lexsort((p, i, h))
    return h[order], i[order], p[order]


def _across(h: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted arrays: which entries' hash is in more than one document, and the first of it."""
    if not len(h):
        return np.empty(0, bool), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(h)]]))
    first, last = i[starts], i[starts + sizes - 1]  # ids are sorted within a hash
    return np.repeat(first != last, sizes), np.repeat(first, sizes)


def _windows_near(words: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows of MIN_WORDS words that contain one of the anchors."""
    n = len(words) - MIN_WORDS + 1
    if n <= 0 or not len(anchors):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(np.maximum(anchors - (MIN_WORDS - ANCHOR), 0), n), 1)
    np.add.at(edge, np.minimum(anchors + 1, n), -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    return at, rolling(words, MIN_WORDS, 22)[at]


SPANS = "doc_id long, start_word int, end_word int, n_words int, first_doc_id long"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_anchors: int = SENT_ANCHORS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id): the spans of each document that
    are made of passages of at least MIN_WORDS words found in another document too.

    Words are as in common.Words, numbered from 0; `end_word` is the one after the last.
    `first_doc_id` is the smallest id that has one of the span's passages; where that is the
    document itself the span is the copy to keep, and such spans are told apart from the
    others. Overlapping and adjoining passages make one span.

    Null ids, null and empty texts and texts under MIN_WORDS words are in no span. Rows with
    one id count as one document, so a text repeated under its own id is not reported, nor
    is repetition within a document. Ids are whole numbers; others are refused.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(id_longs(docs, id_col).alias("id"), docs[text_col].alias("t")).where(F.col("id").isNotNull() & (F.length("t") >= 2 * MIN_WORDS - 1))
    size = plan_bytes(docs) or 4096 * docs.count()
    buckets = max(8, size // BUCKET_BYTES)

    def anchors(batches):
        words = words_of_worker()
        for b in batches:
            rows = [(i, *_anchors(words(t))) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield from _packed(rows, buckets)

    def repeated(table: pa.Table) -> pa.Table:
        h, i, _ = _unpacked(table)
        again, _ = _across(h, i)
        found = np.unique(h[again])
        return pa.table([pa.array([len(found)], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["n", "h"])

    grouped = d.mapInArrow(anchors, _ROW).groupBy("bucket")
    known = written(grouped.applyInArrow(repeated, "n long, h binary"))
    total = known.agg(F.sum("n")).first()[0] or 0
    if total <= sent_anchors:
        sent = spark.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(r["h"] for r in known.select("h").toLocalIterator()), np.uint64)))

        def extend(batches):
            words, all_ = words_of_worker(), sent.value
            for b in batches:
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    w = words(t)
                    at, h = _anchors(w)
                    place = np.searchsorted(all_, h)
                    hit = at[(place < len(all_)) & (all_[np.minimum(place, len(all_) - 1)] == h)] if len(all_) else at[:0]
                    if len(hit):
                        rows.append((i, *_windows_near(w, hit)))
                yield from _packed(rows, buckets)

        near = d.mapInArrow(extend, _ROW)
    else:

        def places(table: pa.Table) -> pa.Table:
            h, i, p = _unpacked(table)
            again, _ = _across(h, i)
            return pa.table([pa.array(i[again], pa.int64()), pa.array(p[again].astype(np.int32))], ["id", "p"])

        hits = grouped.applyInArrow(places, "id long, p int").groupBy("id").agg(F.collect_set("p").alias("p"))

        def extend_joined(batches):
            words = words_of_worker()
            for b in batches:
                rows = [(i, *_windows_near(words(t), np.array(p, np.int64))) for i, t, p in zip(*(c.to_pylist() for c in b.columns))]
                yield from _packed(rows, buckets)

        near = d.join(hits, "id").select("id", "t", "p").mapInArrow(extend_joined, _ROW)

    def match(table: pa.Table) -> pa.Table:
        h, i, p = _unpacked(table)
        again, first = _across(h, i)
        i, p, first = i[again], p[again], first[again]
        to = ((i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets
        order = np.lexsort((p, i, to))
        i, p, first, to = i[order], p[order], first[order], to[order]
        cut = np.concatenate([np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), [len(to)]]) if len(to) else np.zeros(1, np.int64)
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        return pa.table([pa.array([int(to[s]) for s, _ in spans], pa.int32()), *(pa.array([x[s:e].tobytes() for s, e in spans], pa.binary()) for x in (first.view(np.uint64), i, p))], ["bucket", "h", "id", "p"])

    def join(table: pa.Table) -> pa.Table:
        first, i, p = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("h", np.int64), ("id", np.int64), ("p", np.uint32)))
        own, p = first == i, p.astype(np.int64)
        order = np.lexsort((p, own, i))
        first, i, p, own = first[order], i[order], p[order], own[order]
        new = np.concatenate([[True], (i[1:] != i[:-1]) | (own[1:] != own[:-1]) | (p[1:] > p[:-1] + MIN_WORDS)])
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(p)]]) - 1
        start, end = p[at], p[last] + MIN_WORDS
        return pa.table([pa.array(i[at]), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(end - start, pa.int32()), pa.array(np.minimum.reduceat(first, at))], ["doc_id", "start_word", "end_word", "n_words", "first_doc_id"])

    matched = near.groupBy("bucket").applyInArrow(match, _ROW)
    return matched.groupBy("bucket").applyInArrow(join, SPANS)
