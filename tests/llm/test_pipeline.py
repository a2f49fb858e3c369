from collections import Counter

import pytest

import corpus_pipeline
from parcelwise.llm import mixing, packing, registry, rules, secrets, simhash

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage is given and returns, each written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), registry.table(spark, SF_DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        done = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, done))
        docs = done
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(stages):
    assert [name for name, _, _ in stages] == ["quality_rules", "near_dedup", "secret_scan", "mix_sources", "pack_sequences"]
    for _, docs, done in stages[:-1]:
        assert done.dtypes == docs.dtypes


def test_rules(stages):
    _, docs, done = stages[0]
    assert ids(done) == sorted(r["doc_id"] for r in rules.judge(docs).collect() if r["kept"])
    assert 0 < done.count() < docs.count()


def test_rules_shuffle_no_text(spark, stages):
    """The bands travel to the texts, whatever their size is taken for: no document is shuffled, or sorted, by its language."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rules.passing(stages[0][1])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_small_counts(spark, monkeypatch):
    """However few n-grams a worker holds while it learns, the same documents pass."""
    docs = registry.table(spark, SF_DIR, "documents")
    passed = ids(rules.passing(docs))
    monkeypatch.setattr(rules, "COUNTED", 2_000)
    monkeypatch.setattr(rules, "SUMMED", 5_000)
    assert ids(rules.passing(docs)) == passed


def test_dedup(stages):
    _, docs, done = stages[1]
    groups = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert ids(done) == sorted(groups)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in done.collect())


def test_secrets(stages):
    _, docs, done = stages[2]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert ids(docs) == ids(done)
    for r in done.collect():
        spans = secrets.spans_of(texts[r["doc_id"]], registry.vocabulary("byte_bpe_50k.tiktoken"), registry.split_pattern())
        assert (r["text"] == texts[r["doc_id"]]) == (not spans) and r["n_chars"] == len(r["text"])
        assert not [s for s in secrets.base_spans(r["text"])]


def test_mix(stages):
    _, docs, done = stages[3]
    planned = {r["doc_id"]: r["copies"] + (r["part"] > 0) for r in mixing.mix(docs, registry.WEIGHTS).collect()}
    assert Counter(ids(done)) == Counter({i: n for i, n in planned.items() if n})


def test_packing(stages):
    _, docs, done = stages[4]
    rows = done.collect()
    assert Counter(r["doc_id"] for r in rows if not r["piece"]) == Counter(ids(docs))
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= registry.CAPACITY
    assert sum(filled.values()) > 0.98 * registry.CAPACITY * (len(filled) - 1)


def test_run_is_the_stages(spark, stages):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.columns == stages[-1][2].columns
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[k] for k in key) for r in found.collect()) == Counter(tuple(r[k] for k in key) for r in stages[-1][2].collect())


def test_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= docs.count()


def test_stages_alone(spark, odd_docs):
    """Each stage on rows that the ones before would not have kept."""
    assert packing.pack(odd_docs, registry.vocabulary("byte_bpe_50k.json")).count() >= odd_docs.count()
    masked = corpus_pipeline.secret_scan(spark, odd_docs, SF_DIR)
    assert masked.count() == odd_docs.count() and masked.filter("text LIKE '%[SECRET]%'").count() == 1
    assert corpus_pipeline.mix_sources(spark, odd_docs, SF_DIR).columns == odd_docs.columns
