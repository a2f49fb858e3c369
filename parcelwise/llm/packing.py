"""Operator 1: pack tokenized documents into sequences by best-fit decreasing."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.llm.shared import byte_view, in_batches, settled, slices, text_column
from parcelwise.llm.words import CHUNK, SPACE, hashes

PIECES = "row long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
#: Different stretches of text whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Rows that are ranked in one task.
RANKED = 10_000
#: The marks that the vocabulary's own splitting always parts from a letter before them.
MARKS = np.isin(np.arange(256), list(b".,!?;:"))
LETTERS = np.isin(np.arange(256), [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)])
#: White space beyond ASCII; texts with it are left to the library whole.
WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WIDE_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


class Stretches:
    """Token ids of stretches of text between borders that no merge crosses, learnt from the library once per stretch.

    The ids of a text are those of its stretches in order; a worker looks up millions of stretches in sorted arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.library.no_truncation()
        self.feed = self.encoded("\n")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Plain stretches are encoded together, a line each: a line feed parts them and is one id that none of them has."""
        plain = np.array([not (t.isspace() or "\n" in t) for t in texts], bool)
        ids = self.encoded("\n".join(t for t, p in zip(texts, plain) if p))
        feeds = np.flatnonzero(ids == self.feed[0])
        first, past = np.r_[0, feeds + 1], np.r_[feeds, len(ids)]
        assert len(self.feed) == 1 and (not plain.any() or len(first) == plain.sum())
        other = [self.encoded(t) for t, p in zip(texts, plain) if not p]
        at, size = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        at[plain], size[plain] = (first, past - first) if plain.any() else (0, 0)
        size[~plain] = [len(o) for o in other]
        at[~plain] = len(ids) + np.cumsum(size[~plain]) - size[~plain]
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys, self.at = keys[order], np.concatenate([self.at, at + len(self.pool)])[order]
        self.size, self.pool = np.concatenate([self.size, size])[order], np.concatenate([self.pool, ids, *other])

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stretches in order, and how many each has."""
        own, first, place = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        new = own[~np.isin(own, self.keys, assume_unique=True)]
        if len(new):
            which = first[np.searchsorted(own, new)]
            self._learn(new, [data[a:b].tobytes().decode() for a, b in zip(starts[which], ends[which])])
        known = np.searchsorted(self.keys, own)
        at, size = self.at[known][place], self.size[known][place]
        passed = np.cumsum(size) - size
        return self.pool[np.repeat(at - passed, size) + np.arange(size.sum())], size


_stretches = lru_cache(maxsize=1)(Stretches)


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where stretches of texts begin: at white space, at its last character before a word (a blank goes with the word), after
    that character if it is no blank, and at marks after a letter."""
    n = len(data)
    blank = SPACE[data]
    before, after = np.zeros(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    opening = offsets[:-1][offsets[:-1] < n]
    closing = offsets[1:][offsets[1:] > 0] - 1
    before[opening], after[closing] = False, True
    begin = blank & (~before | ~after)
    begin[1:] |= ~blank[1:] & before[1:] & (data[:-1] != 0x20)
    begin[1:] |= MARKS[data[1:]] & LETTERS[data[:-1]]
    begin[opening] = True
    return np.flatnonzero(begin)


def _cuts(data: np.ndarray, most: int) -> list[int]:
    """Where a long text can be cut: before white space that follows a plain character."""
    cuts = [0]
    while len(data) - cuts[-1] > most:
        at = cuts[-1] + most
        while at < len(data):
            here = data[at - 1:at + most]
            found = np.flatnonzero(SPACE[here[1:]] & ~SPACE[here[:-1]] & (here[:-1] < 0x80))
            if len(found):
                at += int(found[0])
                break
            at += most
        if at >= len(data):
            break
        cuts.append(at)
    return [*cuts, len(data)]


def token_ids(texts: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """Each text's ids and `end_id`."""
    stretches = _stretches(path)
    data, offsets = byte_view(texts)
    for a, b in slices(offsets, CHUNK):
        part, own = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        lead = np.flatnonzero(WIDE_LEADS[part])
        wide = set((np.searchsorted(own, lead, "right") - 1).tolist()) if len(lead) else set()
        wide = {i for i in wide if WIDE.search(part[own[i]:own[i + 1]].tobytes().decode())}
        if wide or len(part) > CHUNK:
            for i in range(b - a):
                text, ids = part[own[i]:own[i + 1]], []
                cuts = _cuts(text, CHUNK)
                for x, y in zip(cuts, cuts[1:]):
                    piece = text[x:y]
                    starts = np.empty(0, np.int64) if i in wide or x == y else borders(piece, np.array([0, y - x]))
                    ids.append(stretches.encoded(piece.tobytes().decode()) if i in wide else
                               stretches(piece, starts, np.r_[starts[1:], y - x][:len(starts)])[0])
                yield np.concatenate([*ids, np.array([end_id], np.uint32)])
            continue
        starts = borders(part, own)
        ids, size = stretches(part, starts, np.r_[starts[1:], len(part)][:len(starts)])
        text = np.searchsorted(own, starts, "right") - 1
        lengths = np.bincount(text, size, len(own) - 1).astype(np.int64)
        yield from (np.append(x, np.uint32(end_id)) for x in np.split(ids, np.cumsum(lengths)[:-1]))


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only a longer one is cut, its first piece is the shorter."""
    ids = ids.astype("<u4")
    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
    for k, (start, end) in enumerate(zip(cuts, cuts[1:])):
        yield k, start, end - start, zlib.crc32(ids[start:end])


def tokenized(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of every row of `df`; `row` tells equal ids apart."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def cut(batches):
        for batch in batches:
            found = [(place, *p) for place, ids in enumerate(token_ids(text_column(batch), tokenizer, end_id))
                     for p in pieces_of(ids, capacity)]
            take = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 *[pa.array([f[i + 1] for f in found], k) for i, k in enumerate(kinds)]],
                names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    docs = in_batches(df).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(cut, PIECES.format(id_type=docs.schema["doc_id"].dataType.simpleString()))


class OpenBins:
    """Numbers of open bins by remaining capacity, under a segment tree that finds the tightest which still fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.leaves)  # bins below each node
        self.bins: list[deque] = [deque() for _ in range(capacity + 1)]  # ranges (first, past the last)

    def add(self, room: int, first: int, last: int) -> None:
        self.bins[room].append((first, last))
        self._count(room, last - first)

    def _count(self, room: int, n: int) -> None:
        node = room + self.leaves
        while node:
            self.filled[node] += n
            node //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least `length` that an open bin has."""
        node = length + self.leaves
        while not self.filled[node]:
            while node & 1:  # a right child: nothing to its right below this parent
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to `most` bins with this room, which are removed."""
        first, last = self.bins[room].popleft()
        if last - first > most:
            self.bins[room].appendleft((first + most, last))
            last = first + most
        self._count(room, first - last)
        return first, last


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing for `counts[length]` pieces: rows (length, rank of the first piece, its bin, offset).

    Longer pieces come first and each goes to the tightest open bin. Pieces of one length are alike, and so are bins with
    the same room: as long as such bins last, each takes one piece. So a run of pieces is placed by one search, and the
    plan has as many rows as there are pairs of length and room, whatever the number of documents."""
    bins, opened, rows = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:  # new bins, each filled with as many pieces of this length as it holds
                each = capacity // length
                whole = left // each
                n, fill = (whole, each) if whole else (1, left)
                for k in range(fill):
                    rows.append((length, rank, opened, k * length))
                    rank += n
                if capacity - fill * length:
                    bins.add(capacity - fill * length, opened, opened + n)
                opened += n
                left -= n * fill
                continue
            first, last = bins.take(room, left)
            rows.append((length, rank, first, capacity - room))
            rank, left = rank + last - first, left - (last - first)
            if room > length:
                bins.add(room - length, first, last)
    return np.array(rows, np.int64).reshape(-1, 4)


def _ranked(pieces: DataFrame) -> DataFrame:
    """Adds `rank` from 0 within each length. Pieces of one length are ranked in many tasks: first counted by `part`."""
    rows = pieces.count()
    parts = max(1, -(-rows // RANKED))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(parts)))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "row", "piece")
    ranked = pieces.withColumn("at", F.row_number().over(within) - 1)
    return ranked.join(starts, ["length", "part"]).withColumn("rank", (F.col("first") + F.col("at")).cast("long")).drop("at", "first", "part")


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Packs every row of `df` into sequences of at most `capacity` tokens, as best-fit decreasing does over all rows.

    `tokenizer` is the path of a vocabulary file that every worker can read. A document is the ids of its text (null:
    none) and `end_id`; a longer one is cut into pieces of `capacity` ids, the first of which may be shorter. Returns one row per piece: `id_col`, piece, start,
    length, ids_crc32 (of its little-endian 32-bit ids), sequence_id, offset. Sequences are numbered from 0 and filled
    from offset 0 without gaps. Repeated rows and equal or null ids are documents of their own. An empty table gives an
    empty table; further columns are ignored.

    Best-fit decreasing needs of a piece its length alone. So the pieces are tokenized and kept once, their lengths
    counted (at most `capacity` numbers), the placement of each run of equal lengths planned (at most as many rows as pairs
    of length and room, half of capacity squared), and the plan looked up by every piece's rank within its length."""
    pieces = settled(tokenized(df, tokenizer, capacity, end_id, id_col, text_col))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = df.sparkSession.sparkContext.broadcast(best_fit(counts, capacity))

    def place(batches):
        rows = plan.value
        key = rows[:, 0] << 44 | rows[:, 1]
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            found = rows[np.searchsorted(key, length << 44 | rank, "right") - 1]
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": found[:, 2] + rank - found[:, 1], "offset": found[:, 3]})

    kind = pieces.schema["doc_id"].dataType.simpleString()
    placed = _ranked(pieces).mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("doc_id", id_col)
