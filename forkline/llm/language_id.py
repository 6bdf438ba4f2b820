"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over hashed byte trigrams
(log odds of the trigram in the bit's two groups of languages) votes with a real number;
decoding takes the codeword of least loss, the bits weighted by how well their classifiers
did in training, and calls the text ambiguous if the next codeword is hardly worse.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held, ship

BUCKETS = 1 << 16
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[10, 13, 9]] = 32


def _buckets(raw: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte but the last two."""
    b = _LOWER[raw]
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(16)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +-1. Up to six languages all 2**(n-1) - 1 splits; above that random columns,
    the best of some draws by least distance between rows."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = np.array([[(k >> i) & 1 for k in range(1, 1 << (n - 1))] for i in range(n - 1)] + [[0] * ((1 << (n - 1)) - 1)])
        return (2 * bits - 1).astype(np.int8)
    r, width, best, found = np.random.default_rng(seed), int(10 * np.ceil(np.log2(n))), -1, None
    for _ in range(200):
        m = r.choice(np.array([-1, 1], np.int8), (n, width))
        gap = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if gap > best and (np.abs(m.sum(0)) < n).all():
            best, found = gap, m
    return found


@dataclass(frozen=True)
class Model:
    """Everything that scoring needs: a fixed size, whatever was trained on."""

    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, +-1
    weights: np.ndarray  # bits x (BUCKETS + 1), the last column 0
    scale: np.ndarray  # of each bit's score
    trust: np.ndarray  # weight of each bit's loss

    def scores(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the mean vote of each bit, and its number of trigrams."""
        values = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
        n, k = len(values), len(self.weights)
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
        raw = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.empty(0, np.uint8)
        sums, grams = np.zeros((n, k)), np.maximum(np.diff(ends) - 2, 0)
        at = 0
        while at < n:  # some documents at a time: 4 MB, or one that is larger
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + (4 << 20), "right")) - 1)
            some = np.flatnonzero(grams[at:stop]) + at
            if len(some):
                base, top = int(ends[at]), int(ends[stop])
                idx = _buckets(raw[base:top]).astype(np.int32)
                cut = ends[at + 1 : stop] - base  # trigrams over the border of two texts don't count
                for off in (1, 2):
                    c = cut - off
                    idx[c[(c >= 0) & (c < len(idx))]] = BUCKETS
                starts = ends[some] - base
                for j in range(k):
                    sums[some, j] = np.add.reduceat(self.weights[j][idx], starts)
            at = stop
        return sums / np.maximum(grams, 1)[:, None], grams

    def decode(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the codeword of least weighted loss, and how much worse the next is."""
        if not self.languages:
            return np.zeros(len(means), int), np.zeros(len(means))
        votes = means * self.scale
        loss = np.stack([(np.logaddexp(0, -votes * c) * self.trust).sum(1) for c in self.code], 1) / self.trust.sum()
        if loss.shape[1] == 1:
            return np.zeros(len(loss), int), np.full(len(loss), np.inf)
        order = np.argsort(loss, 1, kind="stable")
        best, second = np.take_along_axis(loss, order[:, :2], 1).T
        return order[:, 0], second - best


def fit(texts: list[str], langs: list[str], seed: int = 5) -> Model:
    """From labelled texts. Trigram counts are summed by language, so the result doesn't
    depend on the order of the texts."""
    names = tuple(sorted(set(langs)))
    if not names:
        raise ValueError("language identification needs labelled rows")
    raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    counts = np.zeros((len(names), BUCKETS))
    for r, lang in zip(raw, langs):
        if len(r) > 2:
            counts[names.index(lang)] += np.bincount(_buckets(r), minlength=BUCKETS)
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)  # each language alike, whatever its rows
    code = codewords(len(names), seed)
    weights = np.zeros((code.shape[1], BUCKETS + 1), np.float32)
    for j, column in enumerate(code.T):
        if (column > 0).any() and (column < 0).any():
            weights[j, :-1] = np.log(share[column > 0].mean(0)) - np.log(share[column < 0].mean(0))
    plain = Model(names, code, weights, np.ones(len(weights)), np.ones(len(weights)))
    means, grams = plain.scores(pa.array(texts, pa.large_string()).cast(pa.large_binary()))
    truth = code[[names.index(x) for x in langs]]
    some = grams > 0
    scale = 4 / np.maximum(np.abs(means[some]).mean(0), 1e-6) if some.any() else plain.scale
    right = ((means[some] * truth[some]) > 0).mean(0) if some.any() else np.ones(len(weights))
    return Model(names, code, weights, scale, np.maximum(2 * right - 1, 0.01))


#: What training without labelled rows gives: no language, so that every text is ambiguous.
UNTRAINED = Model((), np.empty((0, 0)), np.empty((0, BUCKETS + 1), np.float32), np.empty(0), np.empty(0))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 500) -> Model:
    """Fit on a bounded sample of labelled rows: of each language the `rows_per_language`
    rows whose ids have the smallest hashes. That bound is the only thing sampled. The ids
    are chosen without reading any text; rows without id, language or text aren't used. Of
    rows that share id and language one is used, that whose text has the smallest hash, so
    repeated ids don't break the bound. If that leaves no row (an empty table, say), the
    model knows no language."""
    known = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang")).dropna().withColumn("h", F.xxhash64("id"))
    first = known.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("n") <= rows_per_language).select("id", "lang").distinct()
    chosen = [(r["id"], r["lang"]) for r in first.collect()]  # languages x rows_per_language
    pairs = F.broadcast(docs.sparkSession.createDataFrame(chosen, first.schema))
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("t")).where(F.length("t") > 0).join(pairs, ["id", "lang"]).groupBy("id", "lang").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    got = sorted((r["lang"], r["id"], r["t"]) for r in rows.select("lang", "id", "t").toLocalIterator())
    return fit([t for _, _, t in got], [x for x, _, _ in got]) if got else UNTRAINED


def identify(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float = 0.02) -> DataFrame:
    """All rows and columns of `docs` and, under free names, `language`, `margin` and
    `ambiguous`.

    A text is ambiguous if its margin is under `min_margin`, or if it has no three bytes to
    judge by: null, empty and tiny texts have a null language, a null margin and true. Ties
    go to the language first in the alphabet. With a model that knows no language every text
    is treated so. One narrow stage without a shuffle.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    names = [fresh("language", docs), fresh("margin", docs), fresh("ambiguous", docs)]

    def run(batches):
        held("languages", lambda: None)  # nothing of another operator stays in the worker
        words = np.array(model.languages or (None,), object)
        for b in batches:
            means, grams = model.scores(b.column(at).cast(pa.large_string()).cast(pa.large_binary()).fill_null(b""))
            best, margin = model.decode(means)
            none = (grams == 0) | (not model.languages)
            out = [pa.array(words[best].tolist(), pa.string(), mask=none), pa.array(margin, pa.float64(), mask=none), pa.array(none | (margin < min_margin))]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *names])

    kinds = [T.StringType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float = 0.02) -> DataFrame:
    """The rows of `docs`, with their columns, whose language was told without ambiguity. Null,
    empty and tiny texts have none and go; with a model that knows no language all rows go."""
    found = identify(docs, model, text_col, min_margin)
    flag = found.columns[-1]
    return found.where(~F.col(flag)).select(*docs.columns)
