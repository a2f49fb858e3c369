"""Operator 5: a quality classifier on n-gram indicators scaled by naive Bayes, fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.shared import byte_view, in_batches, text_column


@dataclass(frozen=True)
class Setup:
    orders: tuple[int, ...] = (2, 3, 4)  # bytes of the n-grams
    bits: int = 18  # n-grams are hashed to 2**bits features
    smoothing: float = 1.0  # added to each class's counts
    sample: int = 2_000  # labelled texts of each class that the linear model is fitted to, about
    held_back: float = 0.25  # of these, for turning margins into probabilities
    cost: float = 1.0  # of the hinge loss
    epochs: int = 12
    seed: int = 7


#: Bytes of a text that are hashed at once.
PIECE = 1 << 20


class Indicators:
    """The different features of a text. A number written per feature tells one occurrence of each from the others."""

    def __init__(self, setup: Setup):
        self.setup, self.mark = setup, np.zeros(1 << setup.bits, np.int64)

    def _hashed(self, data: np.ndarray) -> np.ndarray:
        wide = data.astype(np.uint64)
        parts, gram = [], wide
        for order in range(1, max(self.setup.orders) + 1):
            if order > 1:
                gram = gram[:-1] | wide[order - 1:] << np.uint64(8 * (order - 1))
            if order in self.setup.orders:
                parts.append((gram + np.uint64(order << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.setup.bits))
        return np.concatenate(parts).astype(np.int64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        longest, found = max(self.setup.orders), []
        for at in range(0, len(data), PIECE):
            piece = data[at:at + PIECE + longest - 1]
            if len(piece) < longest:  # also very short texts have their n-grams
                piece = np.r_[piece, np.full(longest - len(piece), 0x20, np.uint8)]
            index = self._hashed(piece)
            place = np.arange(len(index))
            self.mark[index] = place
            found.append(index[self.mark[index] == place])
        if len(found) > 1:
            return np.unique(np.concatenate(found))
        return found[0] if found else np.empty(0, np.int64)

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = byte_view(texts)
        for a, b in zip(offsets, offsets[1:]):
            yield self(data[a:b])


@dataclass(frozen=True)
class Classifier:
    setup: Setup
    ratio: np.ndarray  # squared log-count ratio of each feature
    weight: np.ndarray  # of each feature's indicator, the ratio included
    slope: float
    shift: float

    def margin(self, index: np.ndarray) -> float:
        """Of a text's features, scaled by the ratios to unit length."""
        norm = float(self.ratio[index].sum())
        return float(self.weight[index].sum()) / norm ** 0.5 if norm > 0 else 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        margins = np.array([self.margin(i) for i in Indicators(self.setup).of(texts)], float)
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def _counted(setup: Setup):
    """Per task and feature: the texts of each class that have it; feature -1: all texts."""
    def run(batches):
        texts = np.zeros(2, np.int64)
        having = np.zeros((2, 1 << setup.bits), np.int64)
        features = Indicators(setup)
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
            for label, index in zip(labels, features.of(text_column(batch))):
                texts[label] += 1
                having[label][index] += 1
        seen = np.flatnonzero(having.any(0))
        yield pa.RecordBatch.from_pydict({"feature": np.r_[-1, seen], "bad": np.r_[texts[0], having[0][seen]],
                                          "good": np.r_[texts[1], having[1][seen]]})

    return run


def log_count_ratios(labelled: DataFrame, setup: Setup) -> np.ndarray:
    """ln of the features' shares in good against bad texts, from all rows of `labelled` (label, text).

    What comes to the driver is a row per feature, 2**bits at most."""
    counts = labelled.select("label", "text").mapInArrow(_counted(setup), "feature long, bad long, good long")
    rows = counts.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter("feature >= 0").toPandas()
    shares = np.full((2, 1 << setup.bits), setup.smoothing)
    shares[:, rows["feature"]] += rows[["bad", "good"]].to_numpy().T
    shares /= shares.sum(1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(indices: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, setup: Setup) -> np.ndarray:
    """Weights (times ratio) of the linear hinge-loss model of texts scaled to unit length.

    Each step solves for one text's dual variable with the others fixed, between 0 and the cost."""
    rng, square = np.random.default_rng(setup.seed), ratio ** 2
    norms = np.array([np.sqrt(square[i].sum()) for i in indices])
    dual, weight = np.zeros(len(indices)), np.zeros(len(ratio))
    # Both classes weigh as much, however many texts each has.
    half = setup.cost * len(signs) / 2
    cost = np.where(signs > 0, half / max((signs > 0).sum(), 1), half / max((signs < 0).sum(), 1))
    for _ in range(setup.epochs):
        for i in rng.permutation(len(indices)):
            if not norms[i]:
                continue
            gradient = signs[i] * weight[indices[i]].sum() / norms[i] - 1  # the scaled text's length is 1
            new = min(max(dual[i] - gradient, 0.0), cost[i])
            if new != dual[i]:
                weight[indices[i]] += (new - dual[i]) * signs[i] * square[indices[i]] / norms[i]
                dual[i] = new
    return weight


def sigmoid_fit(margins: np.ndarray, good: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest probabilities, by damped Newton steps on smoothed labels."""
    wanted = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weights * (p - wanted))
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def learn(df: DataFrame, labels: DataFrame, train: Column, setup: Setup = Setup(), id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Classifier:
    """The classifier from rows of `labels` (`id_col`, `label_col` 0 or 1) where `train` holds, and their texts in `df`.

    Feature counts are over all of them. The linear model is fitted to about `sample` texts of each class, chosen by a hash of their
    ids, as many as fit the driver; a quarter of these sets the probabilities. Rows without label or text row are not learnt from.
    With no labels at all every score is 0.5."""
    named = labels.filter(train & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    texts = in_batches(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Labels grow with the texts: both are dealt by id at every size, as no size at which labels are sent around would last.
    ratio = log_count_ratios(texts.join(named.hint("merge"), "id").select("label", "text"), setup)

    sizes = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, min(1.0, setup.sample / max(sizes.get(1, 1), 1))).otherwise(
        min(1.0, setup.sample / max(sizes.get(0, 1), 1)))
    chosen = F.broadcast(named.filter(chance < share))  # about 2 * sample rows, whatever the input

    def features(batches):
        indicators = Indicators(setup)
        for batch in batches:
            found = [i.astype(np.int32).tobytes() for i in indicators.of(text_column(batch))]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(pa.string()), "label": batch.column(1),
                                              "features": pa.array(found, pa.binary())})

    rows = texts.join(chosen, "id").select("id", "label", "text").mapInArrow(features, "id string, label int, features binary").toPandas()
    rows = rows.sort_values(["id", "label", "features"], ignore_index=True)  # the same whatever order Spark returns
    order = np.random.default_rng(setup.seed).permutation(len(rows))
    indices = [np.frombuffer(rows["features"][i], np.int32) for i in order]
    good = rows["label"].to_numpy()[order] == 1
    back = int(len(order) * setup.held_back)
    weight = dual_descent(indices[back:], np.where(good[back:], 1, -1), ratio, setup)
    fitted = Classifier(setup, ratio ** 2, weight, 1.0, 0.0)
    if not back or good.all() or not good.any():
        return fitted
    margins = np.array([fitted.margin(i) for i in indices[:back]])
    # The sample has as many texts of each class; weighting brings back their shares among all labels.
    total = np.array([max(sizes.get(0, 0), 1), max(sizes.get(1, 0), 1)])
    drawn = np.array([max((~good).sum(), 1), max(good.sum(), 1)])
    weights = (total / drawn)[good[:back].astype(int)]
    slope, shift = sigmoid_fit(margins, good[:back], weights / weights.mean())
    return Classifier(setup, ratio ** 2, weight, slope, shift)


def score(df: DataFrame, classifier: Classifier, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, score, predicted) for every row of `df`, from the whole text alone.

    score is the probability of label 1, predicted is 1 from `threshold` up. Null texts are empty; an empty text has no feature and
    the score that the shift gives. Repeated rows are rows of their own; further columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = classifier.scores(text_column(batch))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "score": found,
                                              "predicted": pa.array((found >= threshold).astype(np.int32))})

    scored = in_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, score double, predicted int")
    return scored.withColumnRenamed("id", id_col)
