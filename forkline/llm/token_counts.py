"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token's bytes are a doubly linked list; a heap of (rank, position) gives the
lowest-ranked adjacent pair again and again. The count is the number of initial symbols
less the number of merges: no identifier is produced.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Bounded, fresh, held, ship

#: Where the vocabulary lies; a parameter of every operator that needs one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The published splitting pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Added for a piece that white space precedes, so that the text is split by the pattern as a whole.
ODD = 1 << 50


#: Pieces of a text after which the memos are looked after.
AT_ONCE = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(1)
def _ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def load(path: str) -> bytes:
    """The vocabulary file's bytes: read by the driver, sent to the workers with the task."""
    with open(path, "rb") as f:
        return f.read()


def merged_count(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one pre-token: its bytes less the merges that apply."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    get = ranks.get
    end = list(range(1, n + 1))  # a symbol is piece[i:end[i]]; 0: merged into the one before
    left = list(range(-1, n - 1))  # the symbol before; the one after starts at end[i]
    width = 26 if n < 1 << 26 else 40
    mask = (1 << width) - 1
    heap = [(r << width | i) << width | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push, merges = heapq.heappop, heapq.heappush, 0
    while heap:
        top = pop(heap)
        stop, i = top & mask, top >> width & mask
        j = end[i]
        if not 0 < j < n or end[j] != stop:
            continue  # one of the two symbols has been merged since
        end[j] = 0
        end[i] = stop
        merges += 1
        if stop < n:
            left[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                push(heap, (r << width | i) << width | end[stop])
        p = left[i]
        if p >= 0 and (r := get(piece[p:stop])) is not None:
            push(heap, (r << width | p) << width | stop)
    return n - merges


class Splitter:
    """Sums a value of pre-tokens over texts. A text is cut before every blank that a
    non-blank follows (the pattern never matches across such a place), so a piece's value
    can be remembered; texts with blanks beside other white space go through the pattern whole."""

    def __init__(self, value):
        self.find = regex.compile(PATTERN).findall
        self.memo = Bounded(self._of_piece)
        self.tokens = Bounded(lambda t: value(t.encode("utf-8", "surrogatepass")))

    def _whole(self, text: str) -> int:
        return sum(map(self.tokens.__getitem__, self.find(text)))

    def _of_piece(self, piece: str) -> int:
        return ODD if not piece or piece[0].isspace() else self._whole(" " + piece)

    def __call__(self, text: str) -> int:
        head, *rest = text.split(" ")
        total = 0
        for k in range(0, len(rest), AT_ONCE):
            total += sum(map(self.memo.__getitem__, rest[k : k + AT_ONCE]))
            self.memo.trim()
            self.tokens.trim()
        return self._whole(text) if total >= ODD else total + self._whole(head)


def _counter(data: bytes) -> Splitter:
    def make():
        ranks = _ranks_of(data)
        return Splitter(lambda piece: merged_count(piece, ranks))

    return held(("counts", data), make)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row of `docs`.

    A null text has a null count, an empty one 0. Rows aren't merged: repeated ids or texts
    give repeated rows, and a null id stays null. Other columns are not read. One narrow
    stage without a shuffle.
    """
    ship(docs.sparkSession)
    data = load(vocabulary)

    def run(batches):
        count = _counter(data)
        for b in batches:
            n = [None if t is None else count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(run, f"id {kind}, n long").toDF(id_col, "n_tokens" if id_col != "n_tokens" else fresh("n_tokens", docs))
