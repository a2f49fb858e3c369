"""Interpolated modified Kneser-Ney models: counted in Spark, kept as sorted hash arrays, mapped by workers.

A model has levels m = 1..n. An entry of level m is a context (the m - 1 symbols before, told by a 64-bit number) and a symbol;
its count is how often it occurs at level n, and below how many different symbols precede it. Entries are summed in buckets, as
many as it takes for a task to hold one, and written as sorted arrays by the task that sums the bucket. Where there are more than
SHARDS buckets, their files are then merged into as many sets: however large the model is, what is looked up is looked up
by bisection in the same few memory-mapped files. No task and no worker holds more than a bucket's arrays in memory of its own."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm.words import mixed, paired

ROWS = "bucket int, entries binary"
#: Entries that a task sums up before it passes them on.
SUMMED = 3 << 19
#: A context before more than this share of all symbols is spread over all buckets.
HEAVY_SHARE = 2000
#: A bucket is meant to hold about so many entries; there are at least so many buckets.
BUCKET_ENTRIES, LEAST_BUCKETS = 1_000_000, 64
#: Sets of files per level that workers look into, at most. The work of a look-up grows with their number, not with that of buckets.
SHARDS = 64
#: Of files that are merged, so many entries (and MERGED_STEP of each file) are held at once.
MERGED, MERGED_STEP = 1 << 20, 1 << 10

#: Context, symbol, count. A context is one number, or a row of numbers: its own, and those of the shorter contexts below it.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def own(context: np.ndarray) -> np.ndarray:
    """The numbers that tell contexts apart."""
    return context if context.ndim == 1 else context[:, 0]


def merged(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> Entries:
    """Entries in order of context and symbol, equal ones added up."""
    order = np.lexsort((symbol, own(context)))
    context, symbol, count = context[order], symbol[order], count[order]
    if not len(context):
        return context, symbol, count
    key = own(context)
    new = np.empty(len(key), bool)
    new[0], new[1:] = True, (key[1:] != key[:-1]) | (symbol[1:] != symbol[:-1])
    at = np.flatnonzero(new)
    return context[at], symbol[at], np.add.reduceat(count, at)


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the greatest needs, after their number and width."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return np.array([len(numbers), kind.itemsize], np.uint64).tobytes() + numbers.astype(kind).tobytes()


def _coded(numbers: np.ndarray) -> bytes:
    """The different numbers and the place of each, where that is shorter; else the numbers and no places."""
    different, place = np.unique(numbers, return_inverse=True)
    plain, places = _narrow(numbers), _narrow(place)
    told = _narrow(different) + places
    return told if len(told) < len(plain) else plain + _narrow(place[:0])


def packed(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> bytes:
    """Merged entries as bytes: each context once, with the number of its entries."""
    key = own(context)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    shorter = [] if context.ndim == 1 else [_coded(column) for column in context[new, 1:].T]
    width = 0 if context.ndim == 1 else context.shape[1]
    return b"".join([np.array([width], np.uint64).tobytes(), _narrow(key[new]), *shorter, _coded(symbol),
                     _narrow(np.diff(np.r_[new, len(key)])), _narrow(count)])


def unpacked(data: bytes) -> Entries:
    at = 8

    def numbers() -> np.ndarray:
        nonlocal at
        n, width = (int(x) for x in np.frombuffer(data, np.uint64, 2, at))
        found = np.frombuffer(data, f"u{width}", n, at + 16)
        at += 16 + n * width
        return found

    def coded() -> np.ndarray:
        told, place = numbers().astype(np.uint64), numbers()
        return told[place] if len(place) else told

    width = int(np.frombuffer(data, np.uint64, 1)[0])
    context = numbers().astype(np.uint64)
    if width:
        context = np.column_stack([context, *(coded() for _ in range(width - 1))])
    symbol = coded()
    runs, count = numbers(), numbers()
    return np.repeat(context, runs.astype(np.int64), axis=0), symbol, count.astype(np.uint64)


@dataclass(frozen=True)
class Route:
    """Which bucket has an entry: all of a context are in one, but for heavy contexts, which are spread by symbol."""

    buckets: int
    heavy: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted

    def is_heavy(self, context: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return np.zeros(len(context), bool)
        at = np.minimum(np.searchsorted(self.heavy, context), len(self.heavy) - 1)
        return self.heavy[at] == context

    def of_context(self, context: np.ndarray) -> np.ndarray:
        return (mixed(context) % np.uint64(self.buckets)).astype(np.int64)

    def __call__(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return np.where(self.is_heavy(context), (paired(context, symbol) % np.uint64(self.buckets)).astype(np.int64),
                        self.of_context(context))


def _name(level: int, bucket: int, route: Route) -> str:
    """What a bucket's files are called: those of a shard, or of a part of one."""
    return f"{level}-{bucket}" if route.buckets <= SHARDS else f"{level}-part{bucket}"


def rows_of(entries: Entries, route: Route) -> pd.DataFrame:
    """Merged entries as one row per bucket."""
    context, symbol, count = entries
    bucket = route(own(context), symbol)
    order = np.argsort(bucket, kind="stable")
    bucket, context, symbol, count = bucket[order], context[order], symbol[order], count[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(bucket)]
    return pd.DataFrame({"bucket": bucket[cuts].astype(np.int32), "entries": [
        packed(context[a:b], symbol[a:b], count[a:b]) for a, b in zip(cuts, ends)]})


def summed(parts: Iterator[Entries], route: Route, most: int | None = None) -> Iterator[pd.DataFrame]:
    """Rows of entries that come in many parts, added up as far as `most` of them (SUMMED unless told) go."""
    most = most or SUMMED
    held: list[Entries] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            entries = merged(*map(np.concatenate, zip(*held)))
            # If little was gained by adding up, waiting for more would gain little too.
            held, size = [entries], len(entries[0])
            if 2 * size >= most:
                yield rows_of(entries, route)
                held, size = [], 0
    if size:
        yield rows_of(merged(*map(np.concatenate, zip(*held))), route)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Written aside and renamed, so that a task that is run twice leaves one whole file."""
    aside = os.path.join(folder, f".{name}-{uuid.uuid4().hex}.npy")
    np.save(aside, array)
    os.replace(aside, os.path.join(folder, f"{name}.npy"))


def _stats(context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each context, and its sum of counts and its numbers of entries counted once, twice and more often."""
    at = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.empty(0, np.int64)
    if not len(at):
        return context[:0], np.empty((0, 4), np.int64)
    columns = [count.astype(np.int64), count == 1, count == 2, count > 2]
    return context[at], np.stack([np.add.reduceat(c.astype(np.int64), at) for c in columns], 1)


def write_bucket(folder: str, level: int, bucket: int, entries: Entries, route: Route) -> None:
    context, symbol, count = own(entries[0]), *entries[1:]
    key = paired(context, symbol)
    order = np.argsort(key)
    name = _name(level, bucket, route)
    _save(folder, f"{name}-keys", key[order])
    _save(folder, f"{name}-counts", _as_wide(count[order]))
    contexts, stats = _stats(context, count)
    heavy = route.is_heavy(contexts)
    order = np.argsort(contexts[~heavy])
    _save(folder, f"{name}-contexts", contexts[~heavy][order])
    _save(folder, f"{name}-stats", _as_wide(stats[~heavy][order]))
    _save(folder, f"{name}-heavy", np.column_stack([contexts[heavy].view(np.int64), stats[heavy]]))
    _save(folder, f"{name}-counted", np.array([int((count == k).sum()) for k in (1, 2, 3, 4)]))


def _as_wide(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.uint64 if numbers.max(initial=0) >= 1 << 32 else np.uint32)


def _merge(folder: str, parts: list[str], whole: str, keys: str, values: str) -> None:
    """One sorted array of the sorted `keys` of `parts`, and one of their `values`, written range by range of keys."""
    found = [[np.load(os.path.join(folder, f"{part}-{kind}.npy"), mmap_mode="r").view(np.ndarray) for kind in (keys, values)] for part in parts]
    steps = np.sort(np.concatenate([key[::MERGED_STEP] for key, _ in found]))
    cuts = steps[MERGED // MERGED_STEP::MERGED // MERGED_STEP]
    ends = [[0, *np.searchsorted(key, cuts), len(key)] for key, _ in found]
    n = sum(len(key) for key, _ in found)
    kinds = [np.uint64, np.result_type(*(value for _, value in found))]
    asides = [os.path.join(folder, f".{whole}-{kind}-{uuid.uuid4().hex}.npy") for kind in (keys, values)]
    with open(asides[0], "wb") as key_file, open(asides[1], "wb") as value_file:
        for file, kind, one in zip((key_file, value_file), kinds, found[0]):
            np.lib.format.write_array_header_1_0(file, {"descr": np.lib.format.dtype_to_descr(np.dtype(kind)), "fortran_order": False,
                                                        "shape": (n, *one.shape[1:])})
        for k in range(len(cuts) + 1):
            key, value = (np.concatenate([arrays[kind][at[k]:at[k + 1]] for arrays, at in zip(found, ends)]) for kind in (0, 1))
            order = np.argsort(key, kind="stable")
            key_file.write(key[order].tobytes())
            value_file.write(value[order].astype(kinds[1]).tobytes())
    for aside, kind in zip(asides, (keys, values)):
        os.replace(aside, os.path.join(folder, f"{whole}-{kind}.npy"))


def _summed_stats(spread: np.ndarray) -> np.ndarray:
    """Rows of a context and its statistics, in order of contexts, those of one context added up."""
    contexts, place = np.unique(spread[:, 0].view(np.uint64), return_inverse=True)
    stats = np.zeros((len(contexts), 5), np.int64)
    np.add.at(stats[:, 1:], place, spread[:, 1:])
    stats[:, 0] = contexts.view(np.int64)
    return stats


def _join(folder: str, level: int, shard: int, route: Route) -> None:
    """Makes a shard's files of its buckets', which are then dropped. A task that is run twice goes on where it ended."""
    parts, whole = [_name(level, bucket, route) for bucket in range(shard, route.buckets, SHARDS)], f"{level}-{shard}"
    if not os.path.exists(os.path.join(folder, f"{whole}-counted.npy")):
        there = [part for part in parts if os.path.exists(os.path.join(folder, f"{part}-counted.npy"))]
        if not there:
            return
        _merge(folder, there, whole, "keys", "counts")
        _merge(folder, there, whole, "contexts", "stats")
        heavy, counted = ([np.load(os.path.join(folder, f"{part}-{kind}.npy")) for part in there] for kind in ("heavy", "counted"))
        _save(folder, f"{whole}-heavy", _summed_stats(np.concatenate(heavy)))
        _save(folder, f"{whole}-counted", np.sum(counted, axis=0))
    for part in parts:
        for kind in ("keys", "counts", "contexts", "stats", "heavy", "counted"):
            with suppress(FileNotFoundError):
                os.unlink(os.path.join(folder, f"{part}-{kind}.npy"))


def joined(spark: SparkSession, folder: str, level: int, route: Route) -> None:
    """Merges the files of a level's buckets, once all are written, so that there are SHARDS sets of files at most."""
    if route.buckets <= SHARDS:
        return

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                _join(folder, level, int(shard), route)
            yield frame

    spark.range(0, SHARDS, 1, SHARDS).mapInPandas(run, "id long").agg(F.count("*")).collect()


def bucket_entries(pdf: pd.DataFrame) -> Entries:
    return merged(*map(np.concatenate, zip(*map(unpacked, pdf["entries"]))))


def _reducer(folder: str, level: int, route: Route, lower: Route | None, shorten) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sums and writes a bucket, and makes the entries of the level below."""
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        entries = bucket_entries(pdf)
        bucket = int(pdf["bucket"].iloc[0])
        write_bucket(folder, level, bucket, entries, route)
        if lower is None:
            return pd.DataFrame({"bucket": [bucket], "entries": [b""]})
        context, symbol, _ = entries
        return rows_of(merged(shorten(context, level), symbol, np.ones(len(symbol), np.uint64)), lower)

    return reduce


def build(rows: DataFrame, folder: str, order: int, routes: dict[int, Route],
          shorten: Callable[[np.ndarray, int], np.ndarray], floor: float) -> "Model":
    """The model of level-`order` entries given as ROWS by `routes[order]`, in `folder`.

    `shorten(context, level)` gives the context of level - 1 (one number at level 1); `floor` is the probability of every symbol before anything
    is counted. Each level is one shuffle of packed entries; the next level's are made where the entries are summed."""
    for level in range(order, 0, -1):
        rows = rows.groupBy("bucket").applyInPandas(_reducer(folder, level, routes[level], routes.get(level - 1), shorten), ROWS)
    rows.agg(F.count("*")).collect()
    for level in range(1, order + 1):
        joined(rows.sparkSession, folder, level, routes[level])
    return Model.opened(folder, order, routes, shorten, floor)


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r").view(np.ndarray) if os.path.exists(path) else None


def discounts(counted: np.ndarray) -> np.ndarray:
    """What is taken from entries counted once, twice and more often, from the numbers counted once to four times.
    Where these numbers are too few for the estimate, the usual 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = (float(x) for x in counted)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(d if 0 < d < k else k / 2 for k, d in enumerate(found, 1))])


@dataclass(frozen=True)
class Model:
    folder: str
    order: int
    routes: dict[int, Route]
    shorten: Callable[[np.ndarray, int], np.ndarray]
    floor: float
    taken: dict[int, np.ndarray]  # discounts by level
    heavy: dict[int, np.ndarray]  # by level: heavy contexts (sorted) with their statistics

    @classmethod
    def opened(cls, folder, order, routes, shorten, floor) -> "Model":
        """Adds up each level's few numbers, of all shards."""
        taken, heavy = {}, {}
        for level in range(1, order + 1):
            counted, spread = np.zeros(4, np.int64), [np.empty((0, 5), np.int64)]
            for shard in range(min(routes[level].buckets, SHARDS)):
                path = os.path.join(folder, f"{level}-{shard}-")
                if os.path.exists(f"{path}counted.npy"):
                    counted += np.load(f"{path}counted.npy")
                    spread.append(np.load(f"{path}heavy.npy"))
            taken[level] = discounts(counted)
            heavy[level] = _summed_stats(np.concatenate(spread))
        return cls(folder, order, routes, shorten, floor, taken, heavy)

    def _search(self, level: int, bucket: np.ndarray, key: np.ndarray, names: tuple[str, str], width: int) -> np.ndarray:
        """Values by key from the sorted arrays of the buckets' shards; zeros where a key is absent."""
        out = np.zeros((len(key), width), np.int64)
        shard = (bucket % SHARDS).astype(np.uint8)
        order = np.argsort(shard, kind="stable") if (key[1:] > key[:-1]).all() else np.lexsort((key, shard))
        shard, key = shard[order], key[order]
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
        for a, b in zip(cuts, np.r_[cuts[1:], len(shard)] if len(shard) else []):
            path = os.path.join(self.folder, f"{level}-{shard[a]}-")
            keys, values = _mapped(f"{path}{names[0]}.npy"), _mapped(f"{path}{names[1]}.npy")
            if keys is None or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key[a:b]), len(keys) - 1)
            hit = keys[at] == key[a:b]
            out[order[a:b][hit]] = values[at[hit]].reshape(-1, width)
        return out

    def counts(self, level: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self._search(level, self.routes[level](context, symbol), paired(context, symbol), ("keys", "counts"), 1)[:, 0]

    def stats(self, level: int, context: np.ndarray) -> np.ndarray:
        different, place = np.unique(context, return_inverse=True)
        route = self.routes[level]
        out = self._search(level, route.of_context(different), different, ("contexts", "stats"), 4)
        spread = self.heavy[level]
        if len(spread):
            keys = spread[:, 0].copy().view(np.uint64)
            at = np.minimum(np.searchsorted(keys, different), len(keys) - 1)
            hit = keys[at] == different
            out[hit] = spread[at[hit], 1:]
        return out[place]

    def probability(self, context: np.ndarray, symbol: np.ndarray, level: int | None = None) -> np.ndarray:
        """p(symbol | context) for pairs, of which equal ones are looked up once."""
        level = self.order if level is None else level
        if not level:
            return np.full(len(symbol), self.floor)
        key = paired(own(context), symbol)
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        context, symbol = context[first], symbol[first]
        lower = self.probability(self.shorten(context, level), symbol, level - 1)
        count, stats, taken = self.counts(level, own(context), symbol), self.stats(level, own(context)), self.taken[level]
        total = stats[:, 0]
        kept = np.maximum(count - taken[np.minimum(count, 3)], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.where(total > 0, (kept + stats[:, 1:] @ taken[1:] * lower) / total, lower)
        return found[place]
