import hashlib
from collections import Counter, defaultdict

import pytest

from brute import WORD
from parcelwise.llm import mixing


def brute_targets(sizes, weights, epochs):
    """Clamp what is above, share out the rest again, until nothing is."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if share * weight[s] > epochs * sizes[s]}
        if not above:
            return target | {s: share * weight[s] for s in open_}
        for s in above:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def check(df, weights=(5, 2, 1), epochs=3, monkeypatch=None):
    rows = mixing.mix(df, list(weights), epochs, keep=("source",)).collect()
    docs = df.select("doc_id", "text", "source").collect()
    sizes, count = Counter(), Counter()
    for r in docs:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        count[r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))] += 1
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == count
    targets, taken = brute_targets(sizes, weights, epochs), Counter()
    for r in rows:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] + r["part"] <= epochs * r["size"] and (0 <= r["part"] < r["size"] or not r["part"])
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    # The fractional repetition goes by the order of the hash.
    by_source = defaultdict(list)
    for r in rows:
        h = hashlib.md5(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        by_source[r["source"]].append((h, r["taken"] / r["size"] if r["size"] else None))
    for own in by_source.values():
        shares = [share for _, share in sorted(own, key=lambda x: x[0]) if share is not None]
        assert shares == sorted(shares, reverse=True)
    return targets, sizes


@pytest.mark.parametrize("digits", [1, 3])
def test_mix(small_docs, digits, monkeypatch):
    monkeypatch.setattr(mixing, "RANGES_HEX", digits)
    check(small_docs)


def test_clamped(spark):
    rows = [(i, "w " * (3 if s == "a" else 40), s) for i, s in enumerate("aaab" * 3 + "bbccddeeffgg")]
    targets, sizes = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert targets["a"] == 3 * sizes["a"]


def test_reruns_agree(small_docs):
    again = [sorted(map(tuple, mixing.mix(df, [5, 2, 1]).collect())) for df in (small_docs, small_docs.repartition(7))]
    assert again[0] == again[1]


def test_odd(spark, odd_docs, no_docs):
    check(odd_docs)
    assert mixing.mix(no_docs, [1]).collect() == [] == mixing.mixed(no_docs, [1]).collect()
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.mix(empty, [5, 2]).collect()} == {(0.0, 0)}


def test_rows_of_the_mix(small_docs):
    planned = {r["doc_id"]: r for r in mixing.mix(small_docs, [5, 2, 1]).collect()}
    texts, got = {r["doc_id"]: r["text"] for r in small_docs.collect()}, defaultdict(list)
    out = mixing.mixed(small_docs, [5, 2, 1])
    assert out.columns == small_docs.columns
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        got[r["doc_id"]].append(r["text"])
    for i, r in planned.items():
        cut = [" ".join(WORD.findall(texts[i])[:r["part"]])] if r["part"] else []
        assert sorted(got[i]) == sorted([texts[i]] * r["copies"] + cut)
