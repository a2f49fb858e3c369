import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from parcelwise.llm import simhash
from parcelwise.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, shingle=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [words] if len(words) < shingle else [words[i:i + shingle] for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in own}


def test_codewords_meet():
    rng = np.random.default_rng(1)
    words, errors = rng.integers(0, 1 << 23, 20_000), np.zeros(20_000, np.int64)
    for _ in range(2):
        errors |= 1 << rng.integers(0, 23, 20_000)
    for a, b in zip(simhash.codewords(words), simhash.codewords(words ^ errors)):
        assert set(a[a >= 0]) & set(b[b >= 0])


def near_prints(seed, groups=30):
    """Groups of many fingerprints around a middle, and chains."""
    rnd, out = random.Random(seed), []
    for _ in range(groups):
        p = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 60])):
            q = p
            for _ in range(rnd.randint(0, 3)):
                q ^= 1 << rnd.randrange(64)
            out.append(q)
    p = rnd.getrandbits(64)
    for i in range(0, 40, 2):
        p ^= 3 << i
        out.append(p)
    return out


@pytest.mark.parametrize("bits,paired", [(2, 32), (2, 2), (1, 2), (0, 2), (2, 10_000)])
def test_links(spark, monkeypatch, bits, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    prints = set(near_prints(bits))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fingerprint long")
    roots = {r["node"] % (1 << 64): r["root"] for r in components(simhash.links(df, bits)).collect()}
    wanted = brute_groups(prints, bits)
    groups, found = Counter(wanted.values()), {}
    for p in prints:
        if groups[wanted[p]] > 1:
            assert found.setdefault(wanted[p], roots[p]) == roots[p]
        else:
            assert p not in roots
    assert len(set(found.values())) == len(found)


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fingerprint long"), 3)


def check(df):
    rows = df.select("doc_id", "text").collect()
    wanted = brute_groups({brute_print(r["text"]) for r in rows}, 2)
    least = {}
    for r in rows:
        root = wanted[brute_print(r["text"])]
        if r["doc_id"] is not None:
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], brute_print(r["text"]), least.get(wanted[brute_print(r["text"])])) for r in rows)
    got = Counter((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == want
    return wanted


def test_near_duplicates(small_docs):
    groups = check(small_docs)
    kept = simhash.deduplicated(small_docs)
    assert kept.columns == small_docs.columns
    assert kept.count() == len(set(groups.values()))


def test_odd(odd_docs, no_docs):
    groups = check(odd_docs)
    assert simhash.deduplicated(odd_docs).count() == len(set(groups.values()))
    assert simhash.near_duplicates(no_docs).collect() == [] == simhash.deduplicated(no_docs).collect()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, n) for n in range(1001, 1200)] + [(5000, 5000), (7, 3), (3, 7)]
    edges += [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in linked}
