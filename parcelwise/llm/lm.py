"""Operator 7: score texts with an interpolated modified Kneser-Ney model of words."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import kneser_ney as kn
from parcelwise.llm.shared import in_batches, mapped_folder, settled, text_column
from parcelwise.llm.words import LOWER, Chunk, bounds, chunks, hashes, named, paired

END, BEGIN = named("end"), named("begin")
#: Words of the longest runs that are counted, unless told. 3 predicts better, for more than twice the disk: figures in the README.
ORDER = 2
#: Tokens that are looked up in the model at once.
LOOKED_UP = 1 << 19


def shorten(context: np.ndarray, level: int) -> np.ndarray:
    """A context carries those below it. Level 1 has one context, 0."""
    return context[:, 1:] if level > 2 else np.zeros(len(context), np.uint64)


class Tokens:
    """Hashed tokens of the texts of a batch, chunk by chunk: words in lower case, then one end per text."""

    def __init__(self, order: int):
        self.order = order
        self.last = self.opening = np.full(order - 1, BEGIN, np.uint64)

    def __call__(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, its contexts of levels `order` to 2, text in the chunk)."""
        data = LOWER[chunk.data]
        starts, ends, text = bounds(chunk)
        n = len(chunk.offsets) - 1
        words = np.bincount(text, minlength=n)
        closed = np.ones(n, np.int64)
        closed[-1] -= chunk.open
        first = np.r_[0, np.cumsum(words + closed)]
        token = np.full(first[-1], END, np.uint64)
        token[np.arange(len(text)) + np.r_[0, np.cumsum(closed)][text]] = hashes(data, starts, ends)
        owner = np.repeat(np.arange(n), words + closed)
        within = np.arange(len(token)) - first[owner]
        if chunk.begun:
            within[owner == 0] += self.order  # all that is before the chunk's first text is its own
        line = np.r_[self.last if chunk.begun else self.opening, token]
        contexts: list[np.ndarray] = []
        for back in range(1, self.order):
            before = line[self.order - 1 - back:len(line) - back].copy()
            before[within < back] = BEGIN
            contexts.insert(0, paired(before, contexts[0]) if contexts else before)
        self.last = line[len(line) - self.order + 1:]  # a text that goes on is alone in its chunk
        return token, np.column_stack(contexts), owner


def _single(batches, route: kn.Route, order: int) -> Iterator[pd.DataFrame]:
    """Tokens by bucket and, in as many buckets after these, contexts of two words and more that are frequent in a chunk."""
    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(bucket=frame["bucket"] + np.int32(route.buckets))

    frequent: list[kn.Entries] = []

    def parts():
        for batch in batches:
            tokens = Tokens(order)
            for chunk in chunks(text_column(batch)):
                all_tokens, contexts, _ = tokens(chunk)
                token, count = np.unique(all_tokens, return_counts=True)
                yield np.zeros(len(token), np.uint64), token, count.astype(np.uint64)
                for column in contexts.T[:-1]:
                    context, times = np.unique(column, return_counts=True)
                    often = 2 * kn.HEAVY_SHARE * times > len(column)
                    frequent.append((np.zeros(often.sum(), np.uint64), context[often], times[often].astype(np.uint64)))
                if sum(len(f[0]) for f in frequent) >= kn.SUMMED:
                    frequent[:] = [kn.merged(*map(np.concatenate, zip(*frequent)))]

    yield from kn.summed(parts(), route)
    yield from split(kn.summed(iter(frequent), route))


def _runs(batches, route: kn.Route, order: int) -> Iterator[pd.DataFrame]:
    def parts():
        for batch in batches:
            tokens = Tokens(order)
            for chunk in chunks(text_column(batch)):
                token, contexts, _ = tokens(chunk)
                yield kn.merged(contexts, token, np.ones(len(token), np.uint64))

    return kn.summed(parts(), route)


def _as_arrow(count, route: kn.Route, order: int):
    def run(batches):
        for frame in count(batches, route, order):
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("bucket", pa.int32()), ("entries", pa.binary())]),
                                             preserve_index=False)

    return run


class Scorer:
    """What a worker needs: the model of runs, and the plain counts of single tokens."""

    def __init__(self, runs: kn.Model, single: kn.Model, tokens: int, types: int):
        self.runs, self.single, self.tokens, self.types = runs, single, tokens, types

    def _looked_up(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token, contexts, text) of LOOKED_UP tokens or somewhat more: the more at once, the fewer pages of the model each costs."""
        tokens, held, size = Tokens(self.runs.order), [], 0
        for chunk in chunks(texts):
            token, contexts, text = tokens(chunk)
            held.append((token, contexts, text + chunk.first))
            size += len(token)
            if size >= LOOKED_UP:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score, score (both log10)."""
        out = {"n_tokens": np.zeros(len(texts), np.int64), "n_known": np.zeros(len(texts), np.int64),
               "base_score": np.zeros(len(texts)), "score": np.zeros(len(texts))}
        for token, contexts, text in self._looked_up(texts):
            types, place = np.unique(token, return_inverse=True)
            known = self.single.counts(1, np.zeros(len(types), np.uint64), types)[place]
            base = np.log10((known + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
            score = np.log10(self.runs.probability(contexts, token))
            for name, weights in (("n_tokens", None), ("n_known", known > 0), ("base_score", base), ("score", score)):
                sums = np.bincount(text, weights, len(texts))
                out[name] += sums.astype(out[name].dtype)
        return out


def learn(texts: DataFrame, order: int = ORDER) -> Scorer:
    """Counts single tokens and runs of `order` (2 or more) of all rows of `texts` (one column, `text`).

    Contexts before more than 1/HEAVY_SHARE of all tokens are spread over all buckets. For words their counts tell; a longer context
    that is so frequent is above half that share in the chunks where it is counted, so that the sum of these counts is above half of
    it too: few are, and none is overlooked."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = in_batches(texts).sparkSession
    folder = mapped_folder(spark, "word-runs")
    route = kn.Route(max(kn.LEAST_BUCKETS, texts.rdd.getNumPartitions()), np.zeros(1, np.uint64))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        entries, bucket = kn.bucket_entries(pdf), int(pdf["bucket"].iloc[0])
        _, token, count = entries
        longer = bucket >= route.buckets
        if longer:
            often, count = count > 0, 2 * count
        else:
            kn.write_bucket(folder + "/single", 1, bucket, entries, route)
            often = count * np.uint64(kn.HEAVY_SHARE) > count.sum()
        most = np.argsort(-count[often].astype(np.int64), kind="stable")[:2 * kn.HEAVY_SHARE * order]  # no more can be above the share
        return pd.DataFrame({"types": [0 if longer else len(token)], "tokens": [0 if longer else int(count.sum())],
                             "often": [token[often][most].view(np.int64).tolist()], "times": [count[often][most].astype(np.int64).tolist()]})

    os.mkdir(folder + "/single")
    rows = texts.mapInArrow(_as_arrow(_single, route, order), kn.ROWS)
    counted = settled(rows.groupBy("bucket").applyInPandas(write, "types long, tokens long, often array<long>, times array<long>"))
    tokens, types = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    # What is before more than 1/HEAVY_SHARE of all tokens: at most so many words, and twice as many longer contexts of each length.
    often = counted.select(F.explode(F.arrays_zip("often", "times")).alias("t")).filter(
        F.col("t.times") * kn.HEAVY_SHARE > int(tokens)).select("t.often").collect()
    heavy = np.unique(np.array([r[0] for r in often], np.int64).view(np.uint64).tolist() + [int(BEGIN)]).astype(np.uint64)
    kn.joined(spark, folder + "/single", 1, route)
    single = kn.Model.opened(folder + "/single", 1, {1: route}, shorten, 0.0)

    upper = kn.Route(max(kn.LEAST_BUCKETS, int(tokens) // kn.BUCKET_ENTRIES), heavy)
    runs = texts.mapInArrow(_as_arrow(_runs, upper, order), kn.ROWS)
    model = kn.build(runs, folder, order, {1: route} | dict.fromkeys(range(2, order + 1), upper), shorten, 1.0 / (int(types) + 1))
    return Scorer(model, single, int(tokens), int(types))


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Scores every row of `df` with a model learnt from the rows where `train` holds.

    Texts are lower-cased (A-Z) and parted at ASCII white space; every text ends with an end token. The model is an
    interpolated modified Kneser-Ney model of runs of up to `order` tokens over all training texts: no run is left out. Symbols never seen get the
    uniform share that interpolation leaves. Returns `id_col`, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (log10 likelihood under single-token counts, half added to each), score (log10 likelihood under the model),
    perplexity (per token). A null text is empty: its only token is the end. Without training texts all symbols are equally
    likely. Repeated rows are rows of their own; further columns are ignored.

    The model is in the shared folder as sorted hash arrays that workers map; it grows with the corpus, what a worker holds
    does not."""
    scorer = learn(df.filter(train).select(F.col(text_col).alias("text")), order)
    kind = df.schema[id_col].dataType.simpleString()
    columns = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}

    def run(batches):
        for batch in batches:
            found = scorer(text_column(batch))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | found)

    scored = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{n} {k}" for n, k in columns.items()))
    return scored.select(F.col("doc_id").alias(id_col), "n_tokens", "n_known", F.lit(scorer.tokens).cast("long").alias("train_tokens"),
                         "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
