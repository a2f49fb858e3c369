import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import language, quality
from parcelwise.llm.shared import fold

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_gradients_by_differences():
    shape = language.Shape(window=12, embedding=3, widths=(2, 3), filters=2)
    network = language.Network(shape, ["a", "b", "c"])
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(1, 256, (5, 12)), rng.integers(0, 3, 5)

    def columns(x):  # as in the network, but not rounded to single precision
        d, widest = 3, 3
        planes = network.p["embed"][x]
        return np.stack([planes[:, j:j + 12 - widest + 1, k] for j in range(widest) for k in range(d)])

    network._columns = columns
    loss = lambda: -network.log_softmax(network.pooled(windows))[np.arange(5), labels].mean()
    for name, gradient in network.gradients(windows, labels).items():
        value = network.p[name]
        for at in list(np.ndindex(*value.shape))[:400:7]:
            old, step = value[at], 1e-6
            value[at] = old + step
            up = loss()
            value[at] = old - step
            down = loss()
            value[at] = old
            if name == "filters" and not network.used[at]:
                assert gradient[at] == 0
            else:
                assert gradient[at] == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_windows_cover_whole_texts():
    texts = pa.array(["", "abc", "x" * 300, "é" * 100], pa.large_string())
    network = language.Network(language.Shape(window=16), ["a", "b"])
    found = network.probabilities(texts, at_once=3)
    assert np.allclose(found.sum(1), 1) and np.allclose(found, network.probabilities(texts))
    from parcelwise.llm.shared import byte_view

    data, offsets = byte_view(texts)
    windows, text = language.windows_of(data, offsets, 16)
    assert b"".join(w.tobytes().rstrip(b"\0") for w in windows) == data.tobytes()
    each = np.exp(network.log_softmax(network.pooled(windows)))
    size = np.array([np.count_nonzero(w) for w in windows])[:, None]
    for i in range(1, 4):
        assert np.allclose(found[i], (each * size)[text == i].sum(0) / size[text == i].sum())


def test_language_held_out(spark, docs):
    held_out = fold(F.col("doc_id")) == 0
    network = language.learn(docs, ~held_out)
    found = language.predict(docs, network).join(docs.select("doc_id", "lang", "text"), "doc_id").filter(held_out).collect()
    clear = [r for r in found if len(r["text"]) > 100]
    assert sum(r["lang_pred"] == r["lang"] for r in clear) / len(clear) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_odd(spark, odd_docs, no_docs, docs):
    network = language.learn(docs, F.lit(True), language.Shape(sample=50, epochs=1))
    rows = language.predict(odd_docs, network).collect()
    assert len(rows) == odd_docs.count()
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (3, 4, 5)} == {("und", 0.0)}
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 6, 7, 10)} <= {"en", "de", "fr", "es"}
    assert language.predict(no_docs, network).collect() == []
    assert language.learn(no_docs, F.lit(True)) is None
    assert {r["lang_pred"] for r in language.predict(odd_docs, None).collect()} == {"und"}


def test_indicators():
    setup = quality.Setup(orders=(1, 2), bits=16)
    indicators = quality.Indicators(setup)
    data = np.frombuffer(b"abcabcabca", np.uint8)
    assert len(indicators(data)) == len(set(indicators(data))) == 6
    assert set(indicators(np.frombuffer(b"cab", np.uint8))) < set(indicators(data))
    assert len(indicators(np.empty(0, np.uint8))) == 0


@pytest.mark.parametrize("piece", [7, 64])
def test_long_texts_in_pieces(monkeypatch, piece):
    data = np.random.default_rng(1).integers(97, 103, 300).astype(np.uint8)
    whole = set(quality.Indicators(quality.Setup())(data).tolist())
    monkeypatch.setattr(quality, "PIECE", piece)
    assert set(quality.Indicators(quality.Setup())(data).tolist()) == whole


def test_dual_descent_is_optimal():
    """The duality gap closes: hinge loss and norm against the dual's value."""
    rng = np.random.default_rng(3)
    setup = quality.Setup(bits=6, epochs=400)
    ratio = rng.normal(0, 1, 64)
    indices = [np.unique(rng.integers(0, 64, 9)) for _ in range(60)]
    signs = np.where(rng.random(60) < 0.5, 1, -1)
    weight = quality.dual_descent(indices, signs, ratio, setup)
    x = np.zeros((60, 64))
    for i, index in enumerate(indices):
        x[i, index] = ratio[index] / np.sqrt((ratio[index] ** 2).sum())
    w = weight / ratio
    cost = np.where(signs > 0, 0.5 / (signs > 0).mean(), 0.5 / (signs < 0).mean())
    primal = 0.5 * w @ w + (cost * np.maximum(0, 1 - signs * (x @ w))).sum()
    for _ in range(200):
        other = w + rng.normal(0, 0.05, 64)
        assert 0.5 * other @ other + (cost * np.maximum(0, 1 - signs * (x @ other))).sum() >= primal - 1e-3


def test_ratios_count_all_rows(spark):
    labelled = spark.createDataFrame([(1, "ab"), (1, "ab"), (0, "cd"), (0, "")], "label int, text string")
    setup = quality.Setup(orders=(2,), bits=10)
    ratio = quality.log_count_ratios(labelled.repartition(3), setup)
    ab, cd = (quality.Indicators(setup)(np.frombuffer(t, np.uint8))[0] for t in (b"ab", b"cd"))
    assert ratio[ab] == pytest.approx(np.log((3 / 1026) / (1 / 1025))) and ratio[cd] == pytest.approx(np.log((1 / 1026) / (2 / 1025)))


def test_quality_held_out(spark, docs):
    labels, held_out = spark.read.parquet(f"{SF_DIR}/labels.parquet"), fold(F.col("doc_id")) == 0
    scored = quality.score(docs, quality.learn(docs, labels, ~held_out))
    rows = scored.filter(held_out).join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.93
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (8, 0), (3, 0), (4, 1), (None, 1), (2, None), (77, 0)], "doc_id long, quality int")
    rows = quality.score(odd_docs, quality.learn(odd_docs, labels, F.lit(True))).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    none = quality.learn(no_docs, labels.filter("false"), F.lit(True))
    assert {r["score"] for r in quality.score(odd_docs, none).collect()} == {0.5}
    assert quality.score(no_docs, none).collect() == []
