"""Token counts, binary shards, the transducer and its decoder."""

import random

import numpy as np
import pytest
import tiktoken

from forkline.llm import bpe
from forkline.llm.token_counts import PATTERN, VOCABULARY, _counter, _ranks_of, count_tokens, load, merged_count
from forkline.llm.token_output import EliasFano, boundaries, document_ids, token_shards

DATA = load(VOCABULARY)
RANKS = _ranks_of(DATA)
ENCODE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={}).encode_ordinary
PIECES = ["a", "b", " ", "  ", "\n", "'s", "é", "1", "ß", " ", "😀", "!", "the", "日本", "\t", "x́", "zzzz", "\x1c", "ing", "tion", " ,"]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(PIECES, k=r.randrange(16))) for _ in range(n)]


def test_counts_and_ids_on_random_texts():
    count, codec = _counter(DATA), bpe.Codec(DATA)
    for t in random_texts(3000, 1):
        want = ENCODE(t)
        assert count(t) == len(want), t
        assert np.frombuffer(codec.encode(t), "<i4").tolist() == want, t
        assert codec.decode(want) == t


def test_merging_one_long_pre_token():
    for piece in (b"a" * 3000, b"abcab" * 500, "é".encode() * 700):
        assert merged_count(piece, RANKS) == len(ENCODE(piece.decode()))


def test_transducer_on_any_bytes_and_with_few_states():
    r = random.Random(3)
    machine = bpe.Transducer(RANKS, limit=200)
    for _ in range(800):
        piece = bytes(r.choices(b"abcdeonrtsh\xc3\xa9\xff", k=r.randrange(1, 14)))
        want = [RANKS[p] for p in bpe.merges_of(piece, RANKS)[0]]
        assert machine.encode(piece) == want, piece


def test_transducer_emits_before_the_end():
    machine = bpe.Transducer(RANKS)
    state, emitted = 0, 0
    for byte in b"x?" * 50:
        arc = machine._step(state, byte)
        state, emitted = arc & 0xFFFFFFFF, emitted + len(machine.outs[arc >> 32])
    assert emitted > 10


def test_utf8_automaton():
    r = random.Random(4)
    for n in range(4000):
        data = bytes(r.choices(range(256), k=r.randrange(12))) if n % 2 else "é😀ß日߿￿".encode()[r.randrange(6) : r.randrange(6, 20)]
        u, out, at = bpe.Utf8(), "", 0
        while at < len(data):  # in pieces of any size
            step = r.randrange(1, 4)
            out += u.push(data[at : at + step])
            at += step
        assert out + u.close() == data.decode("utf-8", "replace")


def test_streaming_decoder_waits_for_whole_characters():
    ids = ENCODE("日本語😀é")
    parts = list(bpe.Decoder(RANKS).stream(ids))
    assert "".join(parts) == "日本語😀é" and "�" not in "".join(parts)


def test_elias_fano():
    r = random.Random(5)
    for _ in range(300):
        v = np.cumsum([r.choice([0, 0, 1, 5, 1000, 100_000]) for _ in range(r.randrange(1, 400))])
        f = EliasFano.encode(v)
        assert f.decode().tolist() == v.tolist() == [f.select(i) for i in range(len(v))]
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 31, 10_000))
    assert EliasFano.encode(v).nbytes() * 8 / len(v) < 2 + np.log2(v[-1] / len(v)) + 1.6
    assert EliasFano.encode(np.empty(0, int)).decode().tolist() == []
    with pytest.raises(IndexError):
        f.select(len(f.decode()))
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))


def expected(rows):
    return [(i, None if t is None else ENCODE(t)) for i, t, *_ in rows]


def test_count_tokens(docs, odd_rows):
    got = sorted((tuple(r) for r in count_tokens(docs(odd_rows, clashing=True)).toDF("doc_id", "n").collect()), key=repr)
    assert got == sorted(((i, None if x is None else len(x)) for i, x in expected(odd_rows)), key=repr)
    assert count_tokens(docs([])).count() == 0


@pytest.mark.parametrize("size", [50, 1_000_000])
def test_shards_hold_every_document(docs, odd_rows, size):
    rows = odd_rows + [(100 + n, t) for n, t in enumerate(random_texts(200, 6))]
    got = []
    shards = token_shards(docs(rows, clashing=True), shard_tokens=size).collect()
    for s in shards:
        ends = boundaries(s)
        assert ends.n == len(s["doc_ids"]) and (ends.n == 1 or s["n_tokens"] <= size)
        got += [(i, document_ids(s, k).tolist()) for k, i in enumerate(s["doc_ids"])]
    assert sorted(got, key=repr) == sorted(((i, x or []) for i, x in expected(rows)), key=repr)
    assert len({s["shard"] for s in shards}) == len(shards)
    assert token_shards(docs([])).count() == 0


def test_encode_and_decode(docs, odd_rows):
    df = docs(odd_rows, clashing=True)
    out = bpe.bpe_encode(df)
    assert out.columns == [*df.columns, "ids_1", "n_ids_1", "round_trip_1"]
    back = bpe.bpe_decode(out, ids_col="ids_1", out_col="label")
    rows = back.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r["label_1"] == r["text"] and r["ids"] == "own ids"
        assert (r["ids_1"], r["round_trip_1"]) == ((None, None) if r["text"] is None else (ENCODE(r["text"]), True))
    assert bpe.bpe_encode(docs([])).count() == 0
