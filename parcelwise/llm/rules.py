"""Operator 8: quality rules: counts of a text, and perplexity bands of its language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import kneser_ney as kn
from parcelwise.llm.shared import byte_view, in_batches, mapped_folder, settled, text_column
from parcelwise.llm.words import SPACE, Chunk, bounds, chunks, hashes, paired

#: Bytes of an n-gram.
ORDER = 5
#: Stands before the first and after the last byte of a word.
EDGE = 0x20
#: Fixed value: what counts as a symbol.
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Log-perplexities are told apart to this step when a language's bands are drawn.
STEP = 0.0005
#: A band reaches so many spreads up from the middle, and so many down; a spread is at least LEAST_SPREAD.
REACH, REACH_DOWN, LEAST_SPREAD = 30.0, 7.0, 0.01
#: Whatever the spread, a band reaches no farther than FARTHEST, and down at least LEAST_DOWN.
FARTHEST, LEAST_DOWN = 0.45, 0.1
#: The share of a text's symbols, in the words that fit worst, that its score leaves out: keys, addresses, short quotes.
SPARED = 0.1
#: Scores of words are added up per text in so many steps of such a width.
SCORES, SCORE_STEP = 128, 1 / 32


def shorten(context: np.ndarray, level: int) -> np.ndarray:
    """Drops the farthest byte; the language in the upper half stays."""
    return (context & np.uint64(0xFFFFFFFF00000000)) | (context & np.uint64((1 << 8 * (level - 2)) - 1 if level > 1 else 0))


def languages(batch: pa.RecordBatch, texts: pa.Array, other: bool = False) -> np.ndarray:
    """Each text's language and half, as the upper half of a number. Null is a language of its own.

    Texts are halved by a checksum; `other` gives the half that a text is not in, whose counts it is scored by. So no text
    vouches for itself, and copies do not vouch for each other."""
    column = batch.column(batch.schema.get_field_index("lang")).cast(pa.string()).dictionary_encode()
    codes = [zlib.crc32(b"l" + v.encode()) for v in column.dictionary.to_pylist()] + [zlib.crc32(b"n")]
    code = np.array(codes, np.uint64)[column.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]
    data, offsets = byte_view(texts)
    half = np.array([zlib.crc32(data[a:b]) & 1 for a, b in zip(offsets, offsets[1:])], np.uint64) ^ np.uint64(other)
    return (code & np.uint64(0xFFFFFFFE) | half) << np.uint64(32)


class Known:
    """Numbers for keys in order of their first appearance, in sorted arrays."""

    def __init__(self):
        self.keys, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of different keys, and which of them are new."""
        new = ~np.isin(keys, self.keys, assume_unique=True)
        merged = np.concatenate([self.keys, keys[new]])
        order = np.argsort(merged, kind="stable")
        self.numbers = np.concatenate([self.numbers, np.arange(len(self.keys), len(merged))])[order]
        self.keys = merged[order]
        return self.numbers[np.searchsorted(self.keys, keys)], new


class Words:
    """The words of a chunk, each different one (by language) once."""

    def __init__(self, chunk: Chunk, lang: np.ndarray):
        self.data, (self.starts, self.ends, text) = chunk.data, bounds(chunk)
        self.text = text + chunk.first
        self.lang = lang[self.text]
        own = paired(hashes(chunk.data, self.starts, self.ends), self.lang)
        self.keys, self.first, self.place, self.times = np.unique(own, return_index=True, return_inverse=True, return_counts=True)

    def ngrams(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, context, symbol) of the bytes of `some` of the different words and of their ends."""
        at = self.first[some]
        starts, sizes = self.starts[at], self.ends[at] - self.starts[at]
        word = np.repeat(np.arange(len(at)), sizes + 1)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)
        begin, size = starts[word], sizes[word]
        padded = np.r_[self.data, np.uint8(EDGE)]
        symbol = np.where(place < size, padded[begin + place], EDGE).astype(np.uint64)
        context = self.lang[at][word]
        for back in range(1, ORDER):
            byte = np.where(place >= back, padded[begin + place - back], EDGE).astype(np.uint64)
            context |= byte << np.uint64(8 * (back - 1))
        return word, context, symbol


#: N-grams of different words whose probabilities a task holds before it forgets them.
HELD = 1 << 20
#: N-grams of different words that a task holds before it passes their counts on, and entries that it adds up: an executor's
#: workers learn side by side, in what memory its JVM leaves.
COUNTED, SUMMED = 1 << 18, 3 << 18


class Counter:
    """Counts of byte n-grams: words are counted first, and the n-grams of each different word taken once."""

    def __init__(self):
        self.known, self.times, self.held, self.size = Known(), np.empty(0, np.int64), [], 0

    def add(self, words: Words) -> None:
        before = len(self.known)
        numbers, new = self.known(words.keys)
        self.times = np.concatenate([self.times, np.zeros(len(self.known) - before, np.int64)])
        self.times[numbers] += words.times
        word, context, symbol = words.ngrams(np.flatnonzero(new))
        self.held.append((numbers[new].astype(np.int32)[word], context, symbol.astype(np.uint8)))
        self.size += len(word)

    def entries(self) -> kn.Entries:
        word, context, symbol = map(np.concatenate, zip(*self.held))
        _, first, place = np.unique(paired(context, symbol), return_index=True, return_inverse=True)
        return context[first], symbol[first].astype(np.uint64), np.bincount(place, self.times[word], len(first)).astype(np.uint64)


def _ngrams(route: kn.Route):
    def parts(batches):
        counter = Counter()
        for batch in batches:
            texts = text_column(batch)
            lang = languages(batch, texts)
            for chunk in chunks(texts):
                counter.add(Words(chunk, lang))
                if counter.size > COUNTED:
                    yield counter.entries()
                    counter = Counter()
        if counter.size:
            yield counter.entries()

    schema = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for frame in kn.summed(parts(batches), route, SUMMED):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    return run


def learn(df: DataFrame) -> kn.Model:
    """The models of all rows of `df` (text, lang): modified Kneser-Ney over the bytes of words, one per language and half."""
    route = kn.Route(kn.LEAST_BUCKETS)
    folder = mapped_folder(df.sparkSession, "byte-ngrams")
    rows = in_batches(df).select("text", "lang").mapInArrow(_ngrams(route), kn.ROWS)
    return kn.build(rows, folder, ORDER, dict.fromkeys(range(1, ORDER + 1), route), shorten, 1 / 256)


def _core(logs: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Mean score per symbol without the SPARED share of the symbols whose words score highest, from sums per text and step."""
    upto = np.cumsum(symbols, 1)
    used = np.clip((1 - SPARED) * upto[:, -1:] - (upto - symbols), 0, symbols)
    mean = np.divide(logs, symbols, out=np.zeros_like(logs), where=symbols > 0)
    total = used.sum(1)
    return np.divide((used * mean).sum(1), total, out=np.full(len(total), np.nan), where=total > 0)


class Perplexity:
    """Mean negative log10 probability of the bytes of a text's words and of their ends, and the same without the words that
    score highest (_core); nan without words. What is found for a word is kept for the texts that follow."""

    def __init__(self, model: kn.Model):
        self.model, self.known, self.logs, self.size = model, Known(), np.empty(0), 0

    def __call__(self, texts: pa.Array, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, symbols = np.zeros(len(texts)), np.zeros(len(texts))
        steps = np.zeros((2, len(texts), SCORES))
        for chunk in chunks(texts):
            words = Words(chunk, lang)
            if not len(words.keys):
                continue
            if self.size > HELD:
                self.known, self.logs, self.size = Known(), np.empty(0), 0
            numbers, new = self.known(words.keys)
            word, context, symbol = words.ngrams(np.flatnonzero(new))
            logs = np.log10(self.model.probability(context, symbol))
            self.logs, self.size = np.concatenate([self.logs, np.bincount(word, logs, int(new.sum()))]), self.size + len(word)
            own, sizes = self.logs[numbers], words.ends - words.starts + 1
            step = np.clip(-own / sizes[words.first] / SCORE_STEP, 0, SCORES - 1).astype(np.int64)[words.place]
            own = own[words.place]
            total += np.bincount(words.text, own, len(texts))
            symbols += np.bincount(words.text, sizes, len(texts))
            first, here = chunk.first, len(chunk.offsets) - 1
            step += (words.text - first) * SCORES
            steps[0, first:first + here] -= np.bincount(step, own, here * SCORES).reshape(here, SCORES)
            steps[1, first:first + here] += np.bincount(step, sizes, here * SCORES).reshape(here, SCORES)
        return np.divide(-total, symbols, out=np.full(len(texts), np.nan), where=symbols > 0), _core(*steps)


def _repeated(word: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text, the words in windows of three that occur twice or more in it."""
    if len(word) < 3:
        return np.zeros(n, np.int64)
    window = paired(paired(word[:-2], word[1:-1]), word[2:])
    window = np.where(text[:-2] == text[2:], paired(window, text[:-2]), 0)
    _, place, times = np.unique(window, return_inverse=True, return_counts=True)
    again = (times[place] > 1) & (window != 0)
    marked = np.zeros(len(word), bool)
    for shift in range(3):
        marked[shift:len(word) - 2 + shift] |= again
    return np.bincount(text[marked], minlength=n)


def _duplicates(lines: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(paired(lines, text), return_index=True)
    later = np.ones(len(lines), bool)
    later[first] = False
    return np.bincount(text[later], minlength=n)


def _lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every line with a word."""
    data, n = chunk.data, len(chunk.data)
    feeds = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.r_[chunk.offsets[:-1], feeds + 1])
    starts = starts[starts < n]
    starts = starts[data[starts] != 0x0A]  # no empty lines; and so a line ends after its start
    stops = np.unique(np.r_[feeds, chunk.offsets[1:]])
    ends = stops[np.searchsorted(stops, starts, "right")]
    letters = np.r_[0, np.cumsum(~SPACE[data])]
    full = letters[ends] > letters[starts]
    starts, ends = starts[full], ends[full]
    return hashes(data, starts, ends), np.searchsorted(chunk.offsets, starts, "right") - 1


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text. Texts that come in parts are counted as a whole: of each word and line a hash is kept."""
    n = len(texts)
    out = {c.split()[0]: np.zeros(n, np.int64) for c in COUNTS.split(", ")}
    parts: list[np.ndarray] = []
    for chunk in chunks(texts):
        starts, ends, text = bounds(chunk)
        here = len(chunk.offsets) - 1
        at = slice(chunk.first, chunk.first + here)
        points = np.r_[0, np.cumsum((chunk.data & 0xC0) != 0x80)]
        signs = np.r_[0, np.cumsum(SYMBOLS[chunk.data])]
        out["n_words"][at] += np.bincount(text, minlength=here)
        out["word_chars"][at] += np.bincount(text, points[ends] - points[starts], here).astype(np.int64)
        out["n_symbols"][at] += signs[chunk.offsets[1:]] - signs[chunk.offsets[:-1]]
        word = hashes(chunk.data, starts, ends)
        if chunk.begun or chunk.open:
            parts.append(word)
            if not chunk.open:
                whole, parts = np.concatenate(parts), []
                out["n_repeat_words"][at] = _repeated(whole, np.zeros(len(whole), np.int64), 1)
                lines = texts[chunk.first].as_py().encode().split(b"\n")
                kept = np.array([hash(line) for line in lines if line.split(None, 1)], np.int64).view(np.uint64)
                out["n_dup_lines"][at] = _duplicates(kept, np.zeros(len(kept), np.int64), 1)
            continue
        out["n_repeat_words"][at] = _repeated(word, text, here)
        out["n_dup_lines"][at] = _duplicates(*_lines(chunk), here)
    return out


def measured(df: DataFrame, model: kn.Model, keep: list[str]) -> DataFrame:
    """`keep` columns of `df` (which has text and lang), COUNTS, base_failed, log_perplexity and core (null without words), and
    digest, a hash of the text."""
    def run(batches):
        perplexity = Perplexity(model)
        for batch in batches:
            texts = text_column(batch)
            columns = base_counts(texts)
            words, again = columns["n_words"], columns["n_repeat_words"]
            logs, core = perplexity(texts, languages(batch, texts, other=True))
            rest = {name: batch.column(batch.schema.get_field_index(name)) for name in [*keep, "digest"]}
            yield pa.RecordBatch.from_pydict(rest | columns | {
                "base_failed": (words < 50) | (100 * again > 50 * words), "log_perplexity": pa.array(logs, from_pandas=True),
                "core": pa.array(core, from_pandas=True)})

    kinds = ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in keep)
    return in_batches(df).select(*dict.fromkeys([*keep, "text", "lang"]), F.xxhash64("text").alias("digest")).mapInArrow(
        run, f"{kinds}, digest long, {COUNTS}, base_failed boolean, log_perplexity double, core double")


def _band(seen: pd.DataFrame) -> pd.DataFrame:
    """One language's band, from the number of texts per step."""
    seen = seen.sort_values("step")
    step, n = seen["step"].to_numpy(), seen["n"].to_numpy()
    upto = np.cumsum(n)
    last = np.searchsorted(upto, upto - n + upto[-1] / 2)  # from each step on, where half of the texts are reached
    first = np.flatnonzero(last < len(step))
    last = last[first]
    best = np.lexsort((step[first], upto[first] - n[first] - upto[last], step[last] - step[first]))[0]
    low, high = step[first[best]] * STEP, (step[last[best]] + 1) * STEP
    middle, spread = (low + high) / 2, max(high - low, LEAST_SPREAD)
    down = min(max(REACH_DOWN * spread, LEAST_DOWN), FARTHEST)
    return pd.DataFrame({"lang": seen["lang"].iloc[:1].array, "low": [middle - down], "high": [middle + min(REACH * spread, FARTHEST)]})


def bands(measures: DataFrame) -> DataFrame:
    """(lang, low, high): the cores between which texts of a language pass, from all different texts that pass the counts.

    Middle and spread are those of the shortest range that holds half of the texts: as long as the others are fewer than half, it
    lies where the language's own texts are, however far off the others. It is read off a histogram, which adds up in any order
    and has as many rows per language as there are steps."""
    texts = measures.filter("NOT base_failed").groupBy("lang", "digest").agg(F.min("core").alias("core"))
    seen = texts.groupBy("lang", F.floor(F.col("core") / STEP).alias("step")).agg(F.count("*").alias("n"))
    return seen.groupBy("lang").applyInPandas(_band, f"lang {seen.schema['lang'].dataType.simpleString()}, low double, high double")


def _with_verdict(measures: DataFrame, limits: DataFrame) -> DataFrame:
    # One row per language: sent round, so that no text is shuffled to meet them, and sorted, by language.
    both = measures.alias("m").join(F.broadcast(limits.alias("b")), F.col("m.lang").eqNullSafe(F.col("b.lang")), "left")
    within = F.col("core").between(F.col("low"), F.col("high"))
    return both.select("m.*", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(`id_col`, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_perplexity, kept) per row.

    A text fails by count with fewer than 50 words, or if over half its words are in a window of three that it repeats. Of the
    others, those are kept whose perplexity lies within the bands of their language: too high is not that language, too low is
    the same over and over. The perplexity is that of the words' bytes under a modified Kneser-Ney model of the language's texts in
    the half of the table (by checksum) that the text is not in; what is held against the bands leaves out the tenth of the
    text that fits worst, so that a key or a short quote does not count.
    Null and empty texts have no words and fail; null is a language of its own. Repeated rows are rows of their own; further
    columns are ignored."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    measures = settled(measured(docs, learn(docs), ["doc_id", "lang"]))
    return _with_verdict(measures, bands(measures)).drop("digest", "core").withColumnRenamed("doc_id", id_col)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (with text and lang) that `judge` keeps, with all their columns."""
    model = learn(docs)
    limits = settled(bands(measured(docs.select("text", "lang"), model, ["lang"])))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang")
    return _with_verdict(measured(rows, model, ["row", "lang"]), limits).filter("kept").select("row.*")
