import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parcelwise.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """(item, rank, doc, score) by scoring every document for every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length, df = len(counts), sum(size for _, _, size in counts), Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c, size in counts:
            m = 100 - 50 + (50 * size * n) // length
            scored.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                               for t in own if t in c), i))
        best = sorted(((s, i) for s, i in scored if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, rank, i, s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "the quick brown FOX"), (2, None), (3, ""), (4, "w3 w4 w59999 jumps"), (None, "ß 二 token"), (4, "lazy Dog dog"), (5, "nowhere0"), (6, "W" * 300_000)]


@pytest.mark.parametrize("block", [lexical.BLOCK_TERMS, 3])
def test_odd(spark, odd_docs, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'clash' AS term", "1 AS score", "'x' AS rank")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for k in (1, 3, 50):
        assert rows(lexical.search(odd_docs, items, k)) == plain(docs, ITEMS, k)


@pytest.mark.parametrize("k", [5, 50])
def test_whole_table(spark, small_docs, k, monkeypatch):
    """Small buckets, so that most are pruned, and copies that tie."""
    monkeypatch.setattr(lexical, "BUCKET", 16)
    docs = small_docs.unionByName(small_docs.withColumn("doc_id", F.col("doc_id") + 1_000)).repartition(3)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()], k)
    assert rows(lexical.search(docs, items, k)) == want


def test_empty(spark, no_docs, small_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(lexical.search(no_docs, items)) == []
    assert rows(lexical.search(small_docs, items.limit(0))) == []


def test_words_of_pieces(monkeypatch):
    text = "Ab c—d, ééé x1.y2 " * 40 + "z" * 100
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(lexical, "PIECE", piece)
        assert [t.decode() for part in lexical.words(text.encode()) for t in part] == terms(text)
