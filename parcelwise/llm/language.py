"""Operator 3: language identification with a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.shared import byte_view, in_batches, text_column

UNKNOWN = "und"
#: Any letter of any alphabet.
LETTER = r"\p{L}"


@dataclass(frozen=True)
class Shape:
    """Sizes of the network and of its training."""

    window: int = 128  # bytes that are looked at at once
    embedding: int = 4
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8  # of each width
    sample: int = 2_000  # texts of each language to learn from, about
    windows: int = 4  # of each such text
    epochs: int = 12
    batch: int = 256
    rate: float = 0.01
    seed: int = 7


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut into windows of `size` bytes (the last padded with 0), and the text that each is from.

    An empty text has no window."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][text] + at * size
    place = starts[:, None] + np.arange(size)
    inside = place < offsets[1:][text][:, None]
    return np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))], 0) if len(data) else np.zeros((0, size), np.uint8), text


class Network:
    """Byte embedding, filters of several widths with rectifier, greatest value of each over the window, softmax.

    Narrow filters are kept as wide ones whose last rows stay zero, so that one product serves all widths."""

    def __init__(self, shape: Shape, classes: list[str]):
        rng = np.random.default_rng(shape.seed)
        self.shape, self.classes = shape, classes
        d, n, widest = shape.embedding, shape.filters * len(shape.widths), max(shape.widths)
        width = np.repeat(shape.widths, shape.filters)
        self.used = (np.arange(widest * d)[:, None] // d < width).astype(np.float32)  # (byte and embedding, filter)
        p = {"embed": rng.normal(0, 0.5, (256, d)), "filters": rng.normal(0, 1, (widest * d, n)) / np.sqrt(width * d) * self.used,
             "shift": np.zeros(n), "out": rng.normal(0, 0.1, (n, len(classes))), "bias": np.zeros(len(classes))}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """(byte and embedding, window, place): what each filter sees at each place."""
        d, widest = self.shape.embedding, max(self.shape.widths)
        span = windows.shape[1] - widest + 1
        columns = np.empty((widest * d, len(windows), span), np.float32)
        for k in range(d):
            plane = np.take(self.p["embed"][:, k], windows)
            for j in range(widest):
                columns[j * d + k] = plane[:, j:j + span]
        return columns

    def _values(self, columns: np.ndarray) -> np.ndarray:
        """(filter, window, place)."""
        return (self.p["filters"].T @ columns.reshape(len(columns), -1)).reshape(-1, *columns.shape[1:])

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self._values(self._columns(windows)).max(2).T + self.p["shift"], 0)

    def log_softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.p["out"] + self.p["bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy. Only the place where a filter is greatest passes anything back."""
        columns = self._columns(windows)
        values = self._values(columns)
        best = values.argmax(2)  # (filter, window)
        pooled = np.maximum(values.max(2).T + self.p["shift"], 0)
        n, d = len(windows), self.shape.embedding
        error = np.exp(self.log_softmax(pooled))
        error[np.arange(n), labels] -= 1
        error /= n
        back = ((error @ self.p["out"].T) * (pooled > 0)).T  # (filter, window)
        picked = columns[:, np.arange(n), best]  # (byte and embedding, filter, window)
        g = {"out": pooled.T @ error, "bias": error.sum(0), "shift": back.sum(1),
             "filters": np.einsum("cfn,fn->cf", picked, back) * self.used}
        widest = max(self.shape.widths)
        seen = windows[np.arange(n)[None, :, None], best[:, :, None] + np.arange(widest)]  # (filter, window, byte)
        passed = back[:, :, None, None] * self.p["filters"].T.reshape(-1, 1, widest, d)
        g["embed"] = np.stack([np.bincount(seen.ravel(), passed[..., k].ravel(), 256) for k in range(d)], 1)
        return g

    def train(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Adam over shuffled batches."""
        s, rng = self.shape, np.random.default_rng(self.shape.seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(s.epochs):
            order = rng.permutation(len(windows))
            rate = s.rate * (1 - epoch / s.epochs)
            for at in range(0, len(order), s.batch):
                step += 1
                some = order[at:at + s.batch]
                for k, g in self.gradients(windows[some], labels[some]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def probabilities(self, texts: pa.Array, at_once: int = 512) -> np.ndarray:
        """Per text and class: the mean over all its windows, each weighted by its bytes. Texts without bytes: equal shares."""
        data, offsets = byte_view(texts)
        size = self.shape.window
        total = np.zeros((len(texts), len(self.classes)))
        counts = -(-np.diff(offsets) // size)
        ends = np.cumsum(counts)
        for a in range(0, int(ends[-1]) if len(ends) else 0, at_once):
            # Windows a.. of all texts, counted through; a text may go on in the next round.
            which = np.arange(a, min(a + at_once, int(ends[-1])))
            text = np.searchsorted(ends, which, "right")
            starts = offsets[text] + (which - (ends - counts)[text]) * size
            place = starts[:, None] + np.arange(size)
            stops = offsets[text + 1]
            windows = np.where(place < stops[:, None], data[np.minimum(place, len(data) - 1)], 0)
            found = np.exp(self.log_softmax(self.pooled(windows))) * np.minimum(stops - starts, size)[:, None]
            np.add.at(total, text, found)
        weight = np.diff(offsets)[:, None]
        return np.where(weight > 0, total / np.maximum(weight, 1), 1 / len(self.classes))


def sampled(df: DataFrame, train: Column, shape: Shape, id_col: str, text_col: str, lang_col: str) -> tuple[list, list]:
    """Windows and languages of a bounded sample: of each language about `sample` texts, chosen by a hash of their ids, and of
    each text `windows` windows at places chosen by hash over its whole length."""
    docs = df.filter(train & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                                                                 F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], []
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, shape.sample / n))])
    letters = docs.filter(chance < share[F.col("lang")]).filter(F.col("text").rlike(LETTER))
    room = F.greatest(F.length("text") - shape.window, F.lit(0)) + 1
    place = F.pmod(F.xxhash64(F.lit("place"), "id", "k"), room).cast("int") + 1
    rows = letters.select("*", F.explode(F.sequence(F.lit(1), F.lit(shape.windows))).alias("k")).select(
        "lang", F.col("text").substr(place, F.lit(shape.window)).alias("text")).collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def learn(df: DataFrame, train: Column, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Network | None:
    """The network trained on a bounded sample of rows where `train` holds and the language is known; None without any."""
    texts, langs = sampled(df, train, shape, id_col, text_col, lang_col)
    if not texts:
        return None
    classes = sorted(set(langs))
    order = np.lexsort((np.array(texts, object).astype(str), np.array(langs)))  # the same whatever order Spark returns
    texts, langs = [texts[i] for i in order], [langs[i] for i in order]
    data, offsets = byte_view(pa.array(texts, pa.large_string()))
    windows, text = windows_of(data, offsets, shape.window)
    network = Network(shape, classes)
    network.train(windows, np.array([classes.index(lang) for lang in langs])[text])
    return network


def predict(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, lang_pred, score) for every row of `df`, from the text alone.

    The whole text is cut into windows of fixed length, of which the network sees many at once; a text's probabilities are the
    windows' means by length, score is that of the language predicted. A text without a letter, also null or empty, is `und` with
    score 0, and so is every text if there was nothing to learn from. Texts of any length are worked off in rounds of a fixed number
    of windows. Repeated rows are rows of their own; an empty table gives an empty table; further columns are ignored."""
    docs = in_batches(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False)).alias("letters"),
                     F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if network is None:
                names, scores = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters))
            else:
                found = network.probabilities(text_column(batch))
                best = found.argmax(1)
                names = np.where(letters, np.array(network.classes, object)[best], UNKNOWN)
                scores = np.where(letters, np.minimum(found[np.arange(len(best)), best], 1.0), 0.0)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "lang_pred": pa.array(names.tolist(), pa.string()),
                                              "score": pa.array(scores.astype(float))})

    return docs.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
