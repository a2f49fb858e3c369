import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parcelwise.llm import pii
from parcelwise.llm.registry import op11_pii

SF_DIR = "/root/testdata/sf0.01"
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base(text):
    found = [(m.start(), list(PATTERNS).index(kind), m.end(), kind) for kind, p in PATTERNS.items() for m in p.finditer(text or "") if passes(kind, m[0])]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def check_base(rows, texts):
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert [r[f"n_{kind}"] for kind in PATTERNS] == [sum(s.startswith(f"{kind}:") for s in want) for kind in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        got = r["spans"].split(",") if r["spans"] else []
        assert set(want) <= set(got)
        assert got == sorted(got, key=lambda s: (int(s.split(":")[1]), list(PATTERNS).index(s.split(":")[0])))


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op11_pii(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    check_base(rows, texts)


def found(spark, tmp_path, texts):
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    df.selectExpr("*", "'x' AS kind", "1 AS start", "'y' AS _row", "2 AS _hits", "'z' AS size", "3 AS _id").write.parquet(f"{tmp_path}/documents.parquet")
    return op11_pii(spark, str(tmp_path)).collect()


def test_base_of_odd_texts(spark, tmp_path):
    """Runs that the patterns touch in odd ways, against Python's matching."""
    rng = random.Random(2)
    pieces = ["a", "b.c", "@", ".", "-", "_", "+", "%", "1", "12", "255", "256", "0", "00010", " ", "  ", "(", ")", "4465758382889437", "ex.org", "é", "😀", "\n", "+1 (017) 555-7713"]
    texts = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60)))) for i in range(1_500)]
    texts += [(2_000, None), (2_001, ""), (2_002, "w" * 3_000), (2_003, "1" * 3_000), (2_004, "1 " * 3_000), (2_005, "+" + "(" * 3_000),
              (2_006, "1." * 2_000), (2_007, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 300.1.2.3.4")]
    rows = found(spark, tmp_path, texts)
    assert len(rows) == len(texts)
    check_base(rows, dict(texts))


def card(rng):
    head = "".join(str(rng.randrange(10)) for _ in range(15))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


@pytest.fixture(scope="module")
def planted():
    """Ordinary spans to learn from, numbers that are none, and spans that the base patterns lose."""
    rng, texts = random.Random(7), []
    for i in range(600):
        number = "".join(str(rng.randrange(10)) for _ in range(16))
        ip = ".".join(str(rng.randrange(1, 256)) for _ in range(4))
        texts.append((i, f"so mail x{i}@mail{i % 9}.example.com then {card(rng)} and {number} or {ip}, phone +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} ok. Version 2.{i}.{i % 7}"))
    lost = [f"Two cards {card(rng)} {card(rng)} side by side", "Call +1 (826) 555-4081 190.137.223.204 today",
            "Write jane.doe7 [at] mail3 [dot] example [dot] com please", "Plain words at home, 12 of 45678 or 1234-5678 and 2024-01-02 10.2"]
    return texts + [(1_000 + i, t) for i, t in enumerate(lost)]


def test_adds_what_is_lost(spark, tmp_path, planted):
    rows = {r["doc_id"]: r["spans"] for r in found(spark, tmp_path, planted)}
    texts = dict(planted)
    said = lambda i: [texts[i][int(s.split(":")[1]):int(s.split(":")[2])] for s in rows[i].split(",") if s]
    assert said(1_000) == texts[1_000].split()[2:4]
    assert said(1_001) == ["+1 (826) 555-4081", "190.137.223.204"]
    assert said(1_002) == ["jane.doe7 [at] mail3 [dot] example [dot] com"]
    assert said(1_003) == []
    assert all(rows[i].split(",") == base(texts[i]) for i in range(600))


def test_odd_table(spark, odd_docs, no_docs):
    got = pii.personal_data(odd_docs)
    assert got.columns == ["doc_id", "pii"] and got.count() == odd_docs.count()
    assert pii.personal_data(no_docs).count() == 0
    assert [r["pii"] for r in got.filter("doc_id IN (3, 4, 6)").collect()] == [[], [], []]


def test_trees_follow_the_counts():
    """Boosting and calibration on cells: scores near the shares of each cell, the threshold at the wanted share."""
    cells = [dict.fromkeys(pii.FEATURES, 0) | {"size": s, "check": c, "yes": int(1000 * p), "no": int(1000 * (1 - p))}
             for s, c, p in ((1, 0, 0.02), (1, 1, 0.95), (2, 0, 0.02), (2, 1, 0.3))]
    trees = pii.boosted(cells, pii.Setup(rounds=60))
    for cell in cells:
        margin = sum(pii._value(t, cell) for t in trees)
        assert 1 / (1 + 2.718281828 ** -margin) == pytest.approx(cell["yes"] / 1000, abs=0.02)
    assert pii.calibrated([(0.1, 1, 9), (0.5, 8, 2), (0.6, 7, 3), (0.9, 95, 5)], pii.Setup(precision=0.9)) == 0.9
    assert pii.calibrated([(0.1, 1, 9), (0.5, 3, 2)], pii.Setup()) is None


def test_redacted(spark):
    row = spark.createDataFrame([("ab😀cdefg",)], "text string").select(pii.redacted(F.col("text"), F.expr(
        "array(named_struct('start', 1, 'end', 3), named_struct('start', 2, 'end', 4), named_struct('start', 6, 'end', 7))"), "#").alias("t")).first()
    assert row["t"] == "a#de#g"
