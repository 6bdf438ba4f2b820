"""Token ids as binary shards with Elias-Fano encoded document boundaries.

A shard is the concatenation of its documents' ids (two bytes each, four for larger
vocabularies). The end offsets of the documents are a non-decreasing sequence, kept as
Elias-Fano: the low bits packed, the high bits in unary in a bit vector, and a sparse
table of sampled ones to start select() from: about 2 + log2(u/n) bits a document and no
table of 64-bit offsets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import Bounded, held, id_longs, ship
from .token_counts import AT_ONCE, PATTERN, VOCABULARY, _ranks_of, load

#: A one is sampled for every so many documents of a shard.
SAMPLE = 64


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of n values up to `top`."""

    n: int
    top: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes  # uint32 positions, in the bit vector, of every SAMPLE-th one

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        if len(v) > 1 and (v[1:] < v[:-1]).any():
            raise ValueError("the values must not decrease")
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = max(0, int(math.log2((top + 1) / n))) if n and top >= n else 0
        place = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
        bits[place] = 1
        low = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, top, width, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), place[::SAMPLE].astype(np.uint32).tobytes())

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        at = i * self.low_bits
        last = (at + self.low_bits - 1) // 8
        return int.from_bytes(self.low[at // 8 : last + 1], "little") >> at % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sampled one, whole bytes are skipped by their population count."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(np.frombuffer(self.samples, np.uint32)[i // SAMPLE])
        left, byte = i % SAMPLE, start // 8
        word = self.high[byte] >> start % 8 << start % 8
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return place - i << self.low_bits | self._low(i)

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) + (low.astype(np.uint64) * weights).sum(1, dtype=np.uint64)

    def nbytes(self) -> int:
        return len(self.low) + len(self.high) + len(self.samples)


class Encoder:
    """Texts to little-endian ids. Pieces between blanks are encoded once (see Splitter)."""

    def __init__(self, ranks: dict[bytes, int], dtype):
        self.whole, self.dtype = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, dtype
        self.memo = Bounded(self._of_piece)

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.whole(text), self.dtype).tobytes()

    def _of_piece(self, piece: str) -> bytes | None:
        return None if not piece or piece[0].isspace() else self._ids(" " + piece)

    def __call__(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        parts = []
        for k in range(0, len(rest), AT_ONCE):
            parts += map(self.memo.__getitem__, rest[k : k + AT_ONCE])
            self.memo.trim()
        return self._ids(text) if None in parts else self._ids(head) + b"".join(parts)


SCHEMA = "shard long, doc_ids array<long>, n_tokens long, token_bytes int, ids binary, n_docs int, low_bits int, low binary, high binary, samples binary"


def token_shards(docs: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Binary shards of all texts: one row each, of about `shard_tokens` ids (a document is never cut).

    `doc_ids` are the shard's documents in the order of their ids; document k of a shard
    spans ids[select(k-1):select(k)]. Null and empty texts take an empty span (their ends
    are ties, which Elias-Fano allows); rows with repeated or null ids each keep their own
    span; ids are whole numbers (common.id_longs). An empty table gives no shard. Shards follow the input's partitions, so nothing
    is shuffled, and a lost task writes the same shards again; `shard` is unique.
    """
    ship(docs.sparkSession)
    data = load(vocabulary)
    wide = max(_ranks_of(data).values(), default=0) >= 1 << 16

    def run(batches):
        from pyspark import TaskContext

        dtype = np.dtype("<u4" if wide else "<u2")
        encode, size = held(("shards", data, wide), lambda: Encoder(_ranks_of(data), dtype)), dtype.itemsize
        part, seq = TaskContext.get().partitionId(), 0
        ids, parts, ends, total = [], [], [], 0

        def shard():
            ef = EliasFano.encode(np.asarray(ends))
            row = {"shard": [(part << 32) + seq], "doc_ids": [ids], "n_tokens": [total], "token_bytes": [size], "ids": [b"".join(parts)], "n_docs": [len(ids)], "low_bits": [ef.low_bits], "low": [ef.low], "high": [ef.high], "samples": [ef.samples]}
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], list(row))

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = encode(text) if text else b""
                if total and total + len(one) // size > shard_tokens:
                    yield shard()
                    ids, parts, ends, total, seq = [], [], [], 0, seq + 1
                ids.append(doc)
                parts.append(one)
                total += len(one) // size
                ends.append(total)
        if ids:
            yield shard()

    return docs.select(id_longs(docs, id_col).alias("id"), docs[text_col].alias("t")).mapInArrow(run, SCHEMA)


def boundaries(row) -> EliasFano:
    """The boundary structure of a shard's row."""
    return EliasFano(row["n_docs"], row["n_tokens"], row["low_bits"], bytes(row["low"]), bytes(row["high"]), bytes(row["samples"]))


def document_ids(row, k: int) -> np.ndarray:
    """The ids of the shard's k-th document, by two selects."""
    ends, dtype = boundaries(row), np.dtype("<u4" if row["token_bytes"] == 4 else "<u2")
    first = ends.select(k - 1) if k else 0
    return np.frombuffer(row["ids"], dtype, ends.select(k) - first, first * dtype.itemsize)
