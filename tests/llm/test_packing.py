import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from parcelwise.llm import packing
from parcelwise.llm.registry import CAPACITY, vocabulary

PATH = vocabulary("byte_bpe_50k.json")
HARD = ["", "  a  b\n\n c d \x1c\x1d e's don't  ", "x" * 5000, "<|endoftext|> hi", "\n\n\n", " a", "a b\nc", "a\n", "a ", "\n", "\na b",
        "a.b,, c... d?! .x ,y é, 中文。 \xa0x\x85", "a \r\n b", "tab\there", "12.5, 3:4; I'm.'s"]


def brute_bins(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 5, 10, 31, 32, 64, 100])
    lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 200))]
    plan, filled = packing.best_fit(Counter(lengths), capacity).tolist(), defaultdict(list)
    for length, n in Counter(lengths).items():
        runs = sorted((r for r in plan if r[0] == length), key=lambda r: r[1])
        for rank in range(n):
            run = [r for r in runs if r[1] <= rank][-1]
            filled[run[2] + rank - run[1]].append((run[3], length))
    assert len(filled) == brute_bins(lengths, capacity)
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("chunk", [packing.CHUNK, 64])
def test_ids_are_the_librarys(chunk, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    rnd = random.Random(5)
    texts = HARD + ["".join(rnd.choice("ab  \n\n.,'é中1\t\r _-") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("ab  \n\n.,'é中1\t\r\u2009_-") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    library = packing._stretches(PATH).library
    wanted = [[*e.ids, 0] for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in packing.token_ids(pa.array(texts, pa.large_string()), PATH, 0)] == wanted


def check(df, capacity):
    rows = packing.pack(df, PATH, capacity).collect()
    library = packing._stretches(PATH).library
    ids = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in df.select("doc_id", "text").collect()]
    wanted = Counter()
    for doc_id, tokens in ids:
        cuts = [0, *range(len(tokens) % capacity or capacity, len(tokens) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[doc_id, k, a, b - a, zlib.crc32(np.array(tokens[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == brute_bins([r["length"] for r in rows], capacity)


def test_pack(small_docs):
    check(small_docs, CAPACITY)


def test_pack_in_many_parts(small_docs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 20)
    check(small_docs, 256)


def test_pack_odd(odd_docs, no_docs):
    check(odd_docs, 64)
    assert packing.pack(no_docs, PATH).collect() == []
