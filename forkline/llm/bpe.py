"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The encoding of every prefix of a pre-token ends in a token that depends only on the
encodings of shorter prefixes: token t ends the prefix of length i if it is compatible
with the token that ends the prefix of length i - len(t) (the pair's bytes encode to just
that pair). A transducer state is what matters of that for the bytes to come: the token
before the oldest boundary still open, and the open boundaries with their pending bytes.
Reading a byte adds one boundary, drops those from which no vocabulary entry can go on,
and emits every token that all remaining boundaries share; so tokens come out after a
lookahead bounded by the longest entry. States and transitions are built when a text first
reaches them and are kept in tables.
"""

from __future__ import annotations

from array import array
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import Bounded, fresh, held, ship, sliced
from .token_counts import AT_ONCE, PATTERN, VOCABULARY, _ranks_of, load


#: The rank of a pair that doesn't merge.
NEVER = 1 << 60

#: Rows that are encoded and sent back together.
SLICE = 500


def merges_of(piece: bytes, ranks: dict[bytes, int], text: dict[int, bytes] | None = None) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
    """What the merge rules make of a few bytes, and each merge's rank with the first and
    the last symbol after it."""
    parts, steps = [piece[i : i + 1] for i in range(len(piece))], []
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank == NEVER:
            break
        parts[i : i + 2] = [text[rank] if text else parts[i] + parts[i + 1]]
        steps.append((rank, parts[0], parts[-1]))
    return parts, steps


class Transducer:
    """encode() runs the states; `states` and `arcs` grow only by what texts reach, and are
    dropped when they exceed `limit` arcs. An arc, by state << 8 | byte, is the next state and,
    from bit 32 on, the place in `outs` of what it emits (0: nothing)."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 300_000):
        self.ranks, self.limit = ranks, limit
        self.text = {i: b for b, i in ranks.items()}
        # The vocabulary's trie as its nodes' strings, with the entry's id or -1.
        self.trie = {p: ranks.get(p, -1) for p in {b[:k] for b in ranks for k in range(1, len(b) + 1)}}
        self.pairs: dict[int, bool] = {}
        self.built: dict[int, list | None] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.arcs: dict[int, int] = {}
        self.outs: list[tuple[int, ...]] = [()]
        self.placed: dict[tuple[int, ...], int] = {(): 0}
        self.shared: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self._state((-1, b"", (), (0,)))

    def _state(self, key: tuple) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        return n

    def _merges(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        """The merges that build a token, or None if the rules alone don't lead to it."""
        if token not in self.built:
            parts, steps = merges_of(self.text[token], self.ranks, self.text)
            self.built[token] = steps if len(parts) == 1 else None
        return self.built[token]

    def _fits(self, before: int, token: int) -> bool:
        """Whether a token may follow another (_step looks into `pairs` first): their own merges
        run side by side, the lowest rank first and of equal ones the left one, and no merge
        across the border comes first."""
        right, key = self._merges(token), before << 20 | token
        left, ok = self._merges(before) if before >= 0 else [], True
        if left is None or right is None:
            ok = False
        elif before >= 0:
            a, b = self.text[before][-1:], self.text[token][:1]
            i, j, get = 0, 0, self.ranks.get
            across = get(a + b, NEVER)
            while True:
                x = left[i][0] if i < len(left) else NEVER
                y = right[j][0] if j < len(right) else NEVER
                if across < x and across <= y:
                    ok = False
                    break
                if x == y == NEVER:
                    break
                if x <= y:
                    c, i = left[i][2], i + 1
                    if c != a:
                        a = c
                        across = get(a + b, NEVER)
                else:
                    c, j = right[j][1], j + 1
                    if c != b:
                        b = c
                        across = get(a + b, NEVER)
        if len(self.pairs) > self.limit // 2:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _step(self, number: int, byte: int) -> int:
        """The arc for one more byte. lasts[i] is the token that ends the first i + 1 pending
        bytes' encoding, or -1 where no open boundary rests on it."""
        before, pending, lasts, opens = self.states[number]
        pending += bytes((byte,))
        size, last, text, trie, known, left = len(pending), -1, self.text, self.trie, self.pairs, []
        for start in opens:  # the longest candidate first
            token = trie.get(pending[start:])
            if token is None:  # no entry can go on from here any more
                continue
            left.append(start)
            if last < 0 <= token:
                previous = lasts[start - 1] if start else before
                fits = known.get(previous << 20 | token)
                if self._fits(previous, token) if fits is None else fits:
                    last = token
        lasts += (last,)
        left.append(size)  # the newest boundary is always open
        root, out = left[0], ()
        if root:  # all open boundaries rest on the tokens up to here
            for at in left:
                while root != at:
                    if root > at:
                        root -= len(text[lasts[root - 1]])
                    else:
                        at -= len(text[lasts[at - 1]])
            at, back = root, []
            while at:
                back.append(lasts[at - 1])
                at -= len(text[back[-1]])
            out = tuple(back[::-1])
        line = set()
        for at in left:
            while at > root and at not in line:
                line.add(at)
                at -= len(text[lasts[at - 1]])
        if len(line) < size - root:
            lasts = tuple([lasts[i] if i + 1 in line else -1 for i in range(root, size)])
        elif root:
            lasts = lasts[root:]
        if root:
            before, pending, left = out[-1], pending[root:], [at - root for at in left]
        # What came before matters only to a token that may still start at the first boundary.
        left = tuple(left)
        nxt = self._state((-1 if left[0] else before, pending, lasts, self.shared.setdefault(left, left)))
        place = self.placed.get(out)
        if place is None:
            place = self.placed[out] = len(self.outs)
            self.outs.append(out)
        return place << 32 | nxt

    def _end(self, number: int) -> tuple[int, ...]:
        _, pending, lasts, _ = self.states[number]
        out, at = [], len(pending)
        while at > 0:
            out.append(lasts[at - 1])
            at -= len(self.text[lasts[at - 1]])
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        if len(self.arcs) > self.limit:
            self._clear()
        out: list[int] = []
        arcs, outs, state = self.arcs, self.outs, 0
        for byte in piece:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                arc = arcs[state << 8 | byte] = self._step(state, byte)
            state = arc & 0xFFFFFFFF
            if arc != state:
                out.extend(outs[arc >> 32])
        tail = self.ends.get(state)
        if tail is None:
            tail = self.ends[state] = self._end(state)
        out.extend(tail)
        return out


class Utf8:
    """An incremental UTF-8 automaton. push() takes any bytes and gives the text that is
    certain by now; an invalid sequence gives U+FFFD for each maximal part, as the Unicode
    standard recommends. close() ends the stream."""

    #: lead byte -> bytes to come and the range allowed for the next one
    LEADS = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)} | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)} | {b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}

    def __init__(self):
        self.wanted, self.low, self.high, self.code = 0, 0x80, 0xBF, 0

    @property
    def state(self) -> tuple[int, int, int, int]:
        return self.wanted, self.low, self.high, self.code

    @state.setter
    def state(self, value) -> None:
        self.wanted, self.low, self.high, self.code = value

    def push(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.wanted:
                if self.low <= b <= self.high:
                    self.wanted, self.code, self.low, self.high = self.wanted - 1, self.code << 6 | b & 0x3F, 0x80, 0xBF
                    if not self.wanted:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.wanted = 0
            if b < 0x80:
                out.append(chr(b))
            elif b in self.LEADS:
                self.wanted, self.low, self.high = self.LEADS[b]
                self.code = b & 0x3F >> self.wanted
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.wanted = "�" * bool(self.wanted), 0
        return left


class Decoder:
    """Ids to text. A token that begins and ends between characters has its text kept in a
    table; the others move the automaton."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.whole = Bounded(self._text, 1 << 22)

    def _text(self, token: int) -> str | None:
        utf8 = Utf8()
        text = utf8.push(self.bytes_of[token])
        return None if utf8.wanted or "�" in text else text

    def stream(self, ids):
        """A piece of text for each id, then what is left."""
        utf8 = Utf8()
        for i in ids:
            text = None if utf8.wanted else self.whole[i]
            yield utf8.push(self.bytes_of[i]) if text is None else text
        yield utf8.close()

    def __call__(self, ids) -> str:
        parts = list(map(self.whole.__getitem__, ids))
        if None in parts:
            return "".join(self.stream(ids))
        return "".join(parts)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans of an array, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """The ids of pieces by the two halves of their digests: sorted arrays, 22 bytes for a
    piece and four for an id, with nothing of Python's for each."""

    def __init__(self):
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.start, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 if it isn't there; `key` is sorted."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def add(self, key: np.ndarray, check: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Pieces that aren't there yet; `key` is sorted and their ids follow one another. Of
        two with one key (and other digests) the second is left out."""
        at = np.searchsorted(self.key, key)
        fresh_ = np.diff(key, prepend=key[:1] - np.uint64(1)) != 0
        if len(self.key):
            fresh_ &= self.key[np.minimum(at, len(self.key) - 1)] != key
        start = len(self.ids) + np.cumsum(sizes) - sizes
        for name, value in (("key", key), ("check", check), ("start", start), ("size", sizes)):
            setattr(self, name, np.insert(getattr(self, name), at[fresh_], value[fresh_]))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])


class Codec:
    """Whole texts to id arrays and back. The different pieces between blanks (see
    token_counts.Splitter) of some texts are looked up together, and pass the transducer
    only if they aren't among the last ones: up to `entries` pieces are remembered."""

    def __init__(self, data: bytes, entries: int = 1_000_000):
        ranks = _ranks_of(data)
        self.transduce, self.decode, self.find = Transducer(ranks).encode, Decoder(ranks), regex.compile(PATTERN).findall
        self.tokens = Bounded(lambda t: self.transduce(t.encode("utf-8", "surrogatepass")), 50_000)
        self.entries, self.young, self.old = entries, Pieces(), Pieces()

    def _ids(self, text: str) -> list[int]:
        out, found = [], self.find(text)
        for k in range(0, len(found), AT_ONCE):  # so that a very long text keeps to the bound, too
            for ids in map(self.tokens.__getitem__, found[k : k + AT_ONCE]):
                out += ids
            self.tokens.trim()
        return out

    def _made(self, pieces: list[str]) -> list[list[int]]:
        """The ids of new pieces: a single pre-token passes the transducer, of the others
        (such as a word and a sign) each word is looked up like a piece."""
        split = [() if p.isalpha() else self.find(" " + p) for p in pieces]
        words = list({t[1:] for s in split if len(s) > 1 for t in s if len(t) > 1 and t[0] == " "})
        known = {}
        if words:
            starts, sizes, ids = self._of_pieces(words)
            known = {" " + w: ids[a:b].tolist() for w, a, b in zip(words, starts.tolist(), (starts + sizes).tolist())}
        out = [self.transduce((" " + p).encode()) if len(s) < 2 else [*chain.from_iterable([known[t] if t in known else self.tokens[t] for t in s])] for p, s in zip(pieces, split)]
        self.tokens.trim()
        return out

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of the ids of each piece, after a blank, in the third array."""
        digest = np.frombuffer(b"".join([xxh3_128_digest(p) for p in pieces]), np.uint64).reshape(-1, 2)
        order = np.argsort(digest[:, 0])
        key, check = digest[order, 0], digest[order, 1]
        sizes, found = np.zeros(len(pieces), np.int32), []
        for table in (self.young, self.old):
            at = table.find(key, check)
            at[sizes > 0] = -1
            hit = np.flatnonzero(at >= 0)
            sizes[hit] = table.size[at[hit]]
            found.append((hit, table.ids[_spans(table.start[at[hit]], sizes[hit])]))
        new = np.flatnonzero(sizes == 0)
        made = self._made([pieces[k] for k in order[new].tolist()]) if len(new) else []
        sizes[new] = np.fromiter(map(len, made), np.int32, len(made))
        found.append((new, np.fromiter(chain.from_iterable(made), np.int32)))
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        ids = np.empty(int(sizes.sum()), np.int32)
        for hit, values in found:
            ids[_spans(starts[hit], sizes[hit])] = values
        young = np.sort(np.concatenate([found[1][0], new]))  # what is used again stays
        self.young.add(key[young], check[young], sizes[young], ids[_spans(starts[young], sizes[young])])
        if len(self.young.key) > self.entries // 2:
            self.old, self.young = self.young, Pieces()
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return starts[back], sizes[back], ids

    def encode_all(self, texts: pa.Array) -> list[bytes | None]:
        """The ids of each text as little-endian bytes, None for null."""
        lists = pc.split_pattern(texts.fill_null(""), pattern=" ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        heads = flat.take(pa.array(ends[:-1] - ends[0]))
        body = np.ones(len(flat), bool)
        body[ends[:-1] - ends[0]] = False
        coded = flat.filter(pa.array(body)).dictionary_encode()
        pieces, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        odd = np.array([not p or p[0].isspace() for p in pieces], bool)
        if odd.any():  # texts with other white space beside a blank go whole through the pattern
            pieces = ["a" if o else p for o, p in zip(odd.tolist(), pieces)]
        starts, sizes, ids = self._of_pieces(pieces)
        n = sizes[which]
        raw = ids[_spans(starts[which], n)].tobytes()
        cuts = np.diff(ends) - 1
        last = np.cumsum(cuts)
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        strange = np.concatenate([[0], np.cumsum(odd[which])])
        of, to = total[last - cuts] * 4, total[last] * 4
        whole = strange[last] > strange[last - cuts]
        out: list[bytes | None] = []
        for k, (head, a, b) in enumerate(zip(heads.to_pylist(), of.tolist(), to.tolist())):
            if not texts[k].is_valid:
                out.append(None)
            else:
                out.append(array("i", self._ids(texts[k].as_py())).tobytes() if whole[k] else array("i", self._ids(head)).tobytes() + raw[a:b])
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


def _codec(data: bytes) -> Codec:
    return held(("codec", data), lambda: Codec(data))


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", verify: bool = True) -> DataFrame:
    """All columns of `docs` and, under names that it doesn't have yet, `ids` (array<int>),
    `n_ids` and, with `verify`, `round_trip` (whether decoding the ids gives the text again).

    Null text: null in all three; empty text: no ids, true. Rows are neither merged nor
    moved, so repeated rows stay and nothing is shuffled.
    """
    ship(docs.sparkSession)
    data = load(vocabulary)
    at = docs.columns.index(text_col)
    names = [fresh("ids", docs), fresh("n_ids", docs)] + [fresh("round_trip", docs)] * verify

    def run(batches):
        codec = _codec(data)
        for b in sliced(batches, SLICE):
            texts = b.column(at).to_pylist()
            parts = [p or b"" for p in codec.encode_all(b.column(at))]
            ends = [0, *accumulate(len(p) // 4 for p in parts)]
            absent = pa.array([t is None for t in texts])
            flat = b"".join(parts)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, "<i4")), mask=absent)
            out = [*b.columns, ids, pa.array([None if t is None else len(p) // 4 for t, p in zip(texts, parts)], pa.int32())]
            if verify:
                out.append(pa.array([None if t is None else codec.decode(np.frombuffer(p, "<i4").tolist()) == t for t, p in zip(texts, parts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, [*b.schema.names, *names])

    kinds = [T.ArrayType(T.IntegerType()), T.IntegerType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    return docs.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns and the decoded text; null ids give null, ids outside the vocabulary are an error."""
    ship(encoded.sparkSession)
    data = load(vocabulary)
    at, name = encoded.columns.index(ids_col), fresh(out_col, encoded)

    def run(batches):
        codec = _codec(data)
        for b in batches:
            text = [None if i is None else codec.decode(i) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, name])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())]))
