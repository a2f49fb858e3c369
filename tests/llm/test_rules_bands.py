import random
import string

import pytest

from parcelwise.llm import rules

KINDS = "doc_id long, text string, lang string"


def gibberish(rnd, n):
    return ["".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(3, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")


def english(docs, n):
    """Texts of prose, 80 words of each."""
    rows = docs.filter("lang = 'en'").dropDuplicates(["text"]).orderBy("doc_id").collect()
    return [" ".join(r["text"].split()[:80]) for r in rows if len(r["text"].split()) >= 80 and "|" not in r["text"]][:n]


def with_share(spark, docs, texts):
    return docs.unionByName(spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(texts)], KINDS))


def kept_of(judged):
    rows = [r for r in judged.filter("lang = 'en' AND NOT base_failed").collect()]
    return [r["kept"] for r in rows if r["doc_id"] >= 0], [r["kept"] for r in rows if r["doc_id"] < 0]


def test_a_third_of_junk(spark, docs):
    rnd = random.Random(1)
    junk = [" ".join(gibberish(rnd, 100)) for _ in range(300)]
    clean, added = kept_of(rules.judge(with_share(spark, docs, junk)))
    assert len(added) == 300 and not any(added)
    assert sum(clean) >= 0.99 * len(clean)


def test_part_gibberish_beside_a_third_of_junk(spark, docs):
    rnd = random.Random(2)
    junk = [" ".join(gibberish(rnd, 100)) for _ in range(250)]
    part = [" ".join(w if i % 10 > 6 else g for i, (w, g) in enumerate(zip(t.split(), gibberish(rnd, 80)))) for t in english(docs, 50)]
    clean, added = kept_of(rules.judge(with_share(spark, docs, junk + part)))
    assert len(added) > 290 and not any(added)
    assert sum(clean) >= 0.99 * len(clean)


def test_part_gibberish(spark, docs):
    rnd = random.Random(6)
    part = [" ".join(w if i % 2 else g for i, (w, g) in enumerate(zip(t.split(), gibberish(rnd, 80)))) for t in english(docs, 20)]
    clean, added = kept_of(rules.judge(with_share(spark, docs, part)))
    assert len(added) > 15 and not any(added)
    assert all(clean)


def test_copies_count_once(spark, docs):
    """A group of copies, more than half of a language's rows, does not set its band."""
    rnd = random.Random(3)
    copies = [" ".join(gibberish(rnd, 100))] * 700
    clean, added = kept_of(rules.judge(with_share(spark, docs, copies)))
    assert len(added) == 700 and not any(added)
    assert sum(clean) >= 0.99 * len(clean)


def test_predictable_texts_go(spark, docs):
    rnd = random.Random(4)
    model = rules.learn(docs)
    words = sorted({w for t in english(docs, 200) for w in t.split()})
    alone = rules.measured(spark.createDataFrame([(w, "en") for w in words], "text string, lang string"), model, ["text"])
    least = [r["text"] for r in alone.orderBy("log_perplexity", "text").limit(12).collect()]
    clean, added = kept_of(rules.judge(with_share(spark, docs, [" ".join(rnd.choice(least) for _ in range(150)) for _ in range(20)])))
    assert len(added) >= 10 and not any(added)
    assert all(clean)


def test_a_key_or_short_quote_stays(spark, docs):
    rnd = random.Random(5)
    signs = string.ascii_letters + string.digits
    quote = docs.filter("lang = 'de'").orderBy("doc_id").first()["text"].split()[:20]
    texts = [t + " " + " ".join("".join(rnd.choice(signs) for _ in range(40)) for _ in range(4)) for t in english(docs, 20)]
    texts += [t + " " + " ".join(quote) for t in english(docs, 20)]
    clean, added = kept_of(rules.judge(with_share(spark, docs, texts)))
    assert len(added) >= 36 and all(added)
    assert all(clean)
