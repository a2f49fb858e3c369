"""Operator 13: ranked lexical search over impact vectors in order of length, pruned by norms and coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from parcelwise.llm.shared import in_batches, settled

# Bytes that part terms, and the letters that are lower-cased. Bytes of other characters are as they are.
BREAKS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
PLAIN = bytes(0x20 if b in BREAKS else b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256))

#: Different terms of the items that are searched for at once. More items are searched in further passes over the documents.
BLOCK_TERMS = 200_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: One document in so many is scored first; its k-th best score bounds the answer's from below.
SEED_SHARE = 16
#: Vectors of a bucket, and numbers of a table of vectors by terms, at most.
BUCKET, TABLE = 250, 4_000_000
#: An item's heaviest coordinates, which are looked at before the others are bounded.
FOCUS = 6
#: Looked up at once when survivors are scored.
LOOKUPS = 2_000_000
#: Bounds are doubles and scores whole numbers: bounds are widened by more than rounding can take off.
WIDER = 1 + 1e-9

COUNTED = "doc_id long, n long, terms array<int>, times array<int>"
VECTORS = "doc_id long, length double, terms array<int>, impacts array<long>"


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of those of about PIECE bytes."""
    at = 0
    while at < len(text):
        part = text[at:at + PIECE]
        if at + PIECE < len(text):  # cut at a break, wherever the next one is
            part = part.translate(PLAIN)
            last = part.rfind(b" ")
            if last < 0:
                rest = text[at + PIECE:].translate(PLAIN)
                last = rest.find(b" ")
                part += rest if last < 0 else rest[:last]
            else:
                part = part[:last + 1]
        at += len(part)
        yield part.translate(PLAIN).split()


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the different terms of all items. Rows with one id, also the null id, are one item."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for place, text in enumerate(_texts(batch, 1)):
                own = sorted({term for part in words(text) for term in part})
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[place].as_py()] * len(own), ids.type), pa.array(own, pa.binary())],
                                                     ["item_id", "term"])

    found = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(found).mapInArrow(run, f"item_id {kind}, term binary").distinct()


@dataclass(frozen=True)
class Search:
    """A block of items: their terms by number, and what is known of the documents."""

    ids: pa.Array  # of the items
    first: np.ndarray  # where each item's terms begin; one more than items
    terms: np.ndarray
    vocabulary: dict[bytes, int]
    k: int
    weights: np.ndarray | None = None
    least: np.ndarray | None = None  # the lowest score of use, per item
    documents: int = 0
    total: int = 0

    @classmethod
    def of(cls, rows: list, kind: pa.DataType, k: int) -> Search:
        by_item: dict = {}
        for item, term in rows:
            by_item.setdefault(item, []).append(bytes(term))
        vocabulary: dict[bytes, int] = {}
        terms = [[vocabulary.setdefault(t, len(vocabulary)) for t in sorted(own)] for own in by_item.values()]
        first = np.r_[0, np.cumsum([len(own) for own in terms])].astype(np.int64)
        flat = np.array([t for own in terms for t in own], np.int64)
        return cls(pa.array(list(by_item), kind), first, flat, vocabulary, k, least=np.ones(len(terms), np.int64))

    def weighted(self, documents: int, total: int, holding: np.ndarray) -> Search:
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding]
        return replace(self, weights=np.array(weights, np.int64), documents=documents, total=total)

    def counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document with terms: their number, and how often it has those of the items."""
        numbers = self.vocabulary.get
        for batch in batches:
            sizes, terms, times, ends = [], [], [], [0]
            for text in _texts(batch, 1):
                n, own = 0, []
                for part in words(text):
                    n += len(part)
                    own += [number for number in map(numbers, part) if number is not None]
                term, count = np.unique(np.array(own, np.int32), return_counts=True)
                sizes.append(n)
                terms.append(term)
                times.append(count.astype(np.int32))
                ends.append(ends[-1] + len(term))
            if sizes:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), pa.int32())) for x in (terms, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    def vectors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Impacts of the items' terms in each document, and the length of the vector that has them times the root of the weight."""
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            own = lists.flatten().to_numpy()
            times = batch.column(3).flatten().to_numpy().astype(np.int64)
            ends = (ends - ends[0]).astype(np.int64)
            m = 50 + (50 * batch.column(1).to_numpy() * self.documents) // max(self.total, 1)
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            impacts = (1_000_000_000 * times) // (1000 * times + 20 * m[row])
            length = np.sqrt(np.bincount(row, self.weights[own] * impacts.astype(float) ** 2, len(batch)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(length), lists, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(impacts))],
                ["doc_id", "length", "terms", "impacts"])

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best documents of these vectors, which come longest first, for each item."""
        scan = _Scan(self)
        for batch in batches:
            if not scan.bucket_wise(batch):
                break  # no shorter vector can reach any item's lowest score
        yield scan.found()


class _Scan:
    """One task's way through vectors in order of length."""

    def __init__(self, search: Search):
        s = self.search = search
        self.n = len(s.ids)
        self.roots = np.sqrt(s.weights.astype(float))
        self.least = s.least.copy()
        self.item = np.repeat(np.arange(self.n), np.diff(s.first))
        square = s.weights[s.terms].astype(float)
        self.norm = np.sqrt(np.bincount(self.item, square, self.n))
        # Coordinates in focus: an item's heaviest, that is rarest, terms.
        order = np.lexsort((-square, self.item))
        self.focused = np.zeros(len(order), bool)
        self.focused[order] = np.arange(len(order)) - s.first[self.item[order]] < FOCUS
        self.rest_norm = np.sqrt(np.maximum(self.norm ** 2 - np.bincount(self.item[self.focused], square[self.focused], self.n), 0))
        by_term = np.argsort(s.terms[self.focused], kind="stable")
        self.focus_item = self.item[self.focused][by_term]
        self.focus_first = np.searchsorted(s.terms[self.focused][by_term], np.arange(len(s.vocabulary) + 1))
        self.rest_term, self.rest_item = s.terms[~self.focused], self.item[~self.focused]
        self.height = min(BUCKET, max(16, TABLE // max(len(s.vocabulary), self.n, 1)))
        nothing = np.empty(0, np.int64)
        self.pool = (nothing, nothing, nothing, np.empty(0, bool))  # item, score, document, whether it has no id

    def bucket_wise(self, batch: pa.RecordBatch) -> bool:
        lists, lengths = batch.column(2), batch.column(1).to_numpy()
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        terms, impacts = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        docs = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        for a in range(0, len(batch), self.height):
            b = min(a + self.height, len(batch))
            live = self.norm * lengths[a] * WIDER >= self.least  # Cauchy-Schwarz for the longest, hence for the bucket
            if not live.any():
                return False
            part = slice(ends[a], ends[b])
            row = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
            self._bucket(live, lengths[a:b], row, terms[part], impacts[part], docs[0][a:b], docs[1][a:b])
        return True

    def _bucket(self, live, lengths, row, term, impact, docs, missing) -> None:
        rows, value = len(lengths), self.roots[term] * impact
        count = self.focus_first[term + 1] - self.focus_first[term]
        at = np.flatnonzero(count)
        place = np.repeat(self.focus_first[term[at]], count[at])
        place += np.arange(len(place)) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
        entry, item = np.repeat(at, count[at]), self.focus_item[place]
        kept = live[item]
        entry, item = entry[kept], item[kept]
        cell = row[entry] * self.n + item
        known = np.bincount(cell, self.roots[term[entry]] * value[entry], rows * self.n).reshape(rows, self.n)
        square = np.bincount(cell, value[entry] ** 2, rows * self.n).reshape(rows, self.n)
        # What the other coordinates can add: by their length, and by the greatest of each in this bucket.
        greatest = np.zeros(len(self.roots))
        np.maximum.at(greatest, term, value)
        most = np.bincount(self.rest_item, self.roots[self.rest_term] * greatest[self.rest_term], self.n)
        other = self.rest_norm * np.sqrt(np.maximum((lengths * WIDER)[:, None] ** 2 - square, 0))
        hit = (known + np.minimum(other, most)) * WIDER >= self.least
        survivor, item = np.nonzero(hit & live)
        table = np.zeros((rows, len(self.roots)), np.int64)
        table[row, term] = self.search.weights[term] * impact
        sizes = np.diff(self.search.first)[item]
        edges = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + LOOKUPS, LOOKUPS), "left")
        for a, b in zip(edges, [*edges[1:], len(item)]):
            if a < b:
                self._score(survivor[a:b], item[a:b], table, docs, missing)

    def _score(self, row, item, table, docs, missing) -> None:
        first, sizes = self.search.first[item], np.diff(self.search.first)[item]
        begin = np.cumsum(sizes) - sizes
        place = np.repeat(first - begin, sizes) + np.arange(sizes.sum())
        score = np.add.reduceat(table[np.repeat(row, sizes), self.search.terms[place]], begin)
        good = score >= self.least[item]
        new = item[good], score[good], docs[row[good]], missing[row[good]]
        self.pool = tuple(np.concatenate(pair) for pair in zip(self.pool, new))
        if len(self.pool[0]) > 2 * self.n * self.search.k:
            self._settle()

    def _settle(self) -> None:
        item, score, doc, missing = self.pool
        order = np.lexsort((doc, missing, -score, item))
        sorted_item = item[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item)
        order, rank = order[rank < self.search.k], rank[rank < self.search.k]
        self.pool = tuple(x[order] for x in self.pool)
        last = rank == self.search.k - 1
        self.least[self.pool[0][last]] = np.maximum(self.least[self.pool[0][last]], self.pool[1][last])

    def found(self) -> pa.RecordBatch:
        self._settle()
        item, score, doc, missing = self.pool
        return pa.RecordBatch.from_arrays([self.search.ids.take(pa.array(item)), pa.array(doc, mask=missing), pa.array(score)],
                                          ["item_id", "doc_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """The `k` documents with the highest score above 0 for every item: item_id, rank (from 1), doc_id, score.

    Terms are the runs of characters other than ASCII breaks, A-Z lower-cased. With N documents that have terms, L terms in
    them, n in this one, df documents with a term and tf its times in this one, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1)))
    and its impact is 10^9 tf div (1000 tf + 20 m), m = 50 + 50 n N div L. The score is the sum of w times impact over an item's
    terms, once each; equal scores are in order of doc_id, a null id last.

    Every task takes its documents' impact vectors in order of length, in buckets. A bucket is skipped for an item if the product
    of lengths (Cauchy-Schwarz) is under the item's k-th best score so far, in the bucket a document is, if its heaviest
    coordinates and a bound of the others are; the rest are scored in whole numbers. A k-th best score to start with comes from
    one document in SEED_SHARE, so that a task returns few rows that are not in the answer.

    Null and empty texts have no terms: such documents do not count, such items have no rows. Rows with one item id (also null) are
    one item; rows of `docs` with one id are documents of their own, and repeated rows rank one after the other. Empty tables give
    an empty table. Further columns are ignored. What the tasks are sent is a block of items with BLOCK_TERMS different terms
    in all, or one longer item; each block is a pass over `docs`."""
    spark = docs.sparkSession
    kind = items.schema[item_id_col].dataType.simpleString()
    asked = settled(item_terms(items, item_id_col, item_text_col))
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    answers = []
    for number in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        rows = block.collect()  # BLOCK_TERMS of them, about
        if not rows:
            continue
        one = Search.of([(r["item_id"], r["term"]) for r in rows], to_arrow_type(asked.schema["item_id"].dataType), k)
        counted = settled(in_batches(texts).mapInArrow(one.counted, COUNTED).filter("n > 0"))
        documents, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = np.zeros(len(one.vocabulary), np.int64)
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a block's terms at most
            holding[r["term"]] = r["count"]
        one = one.weighted(documents, total, holding)
        vectors = counted.filter(F.size("terms") > 0)
        order = F.desc("length")
        found = f"item_id {kind}, doc_id long, score long"
        seeds = (vectors.filter(F.pmod(F.xxhash64("doc_id", "n", "times"), F.lit(SEED_SHARE)) == 0)
                 .mapInArrow(one.vectors, VECTORS).sortWithinPartitions(order).mapInArrow(one.best, found))
        places = {item: place for place, item in enumerate(one.ids.to_pylist())}
        least = one.least.copy()
        for r in _ranked(seeds, k).filter(F.col("rank") == k).collect():  # one row per item of the block
            least[places[r["item_id"]]] = r["score"]
        one = replace(one, least=least)
        answers.append(vectors.mapInArrow(one.vectors, VECTORS).sortWithinPartitions(order).mapInArrow(one.best, found))
    if not answers:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    whole = answers[0]
    for more in answers[1:]:
        whole = whole.unionByName(more)
    return _ranked(whole, k).select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
sized AS (SELECT r, doc_id, len(t) AS n, t FROM texts WHERE len(t) > 0),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sized),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM sized) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term, big_n),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT a.item_id, s.doc_id, s.r,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked a JOIN postings USING (term) JOIN weights USING (term) JOIN sized s USING (r), totals
  GROUP BY a.item_id, s.doc_id, s.r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
