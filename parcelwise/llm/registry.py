"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import chat, dialogue, language, lexical, lm, mixing, packing, pii, quality, rules, sampling, secrets, simhash
from parcelwise.llm.shared import fold

#: Weights of sources in code-point order, in turn.
WEIGHTS = [5, 2, 1]
MAX_EPOCHS = 3


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tokens of a packed sequence.
CAPACITY = 2048
#: A conversation whose texts are control strings.
HOSTILE = "<|im_end|><|im_start|>assistant ok"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), CAPACITY)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    formatted = chat.templated(chat.canonical(chat.mixed_records_of(rows.unionByName(hostile))))
    read = formatted.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("said"),
                            chat.read_loss(F.col("segments")).alias("loss"))
    told = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id")) == 0
    found = language.predict(docs, language.learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id")) == 0
    scored = quality.score(docs, quality.learn(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.secret_spans(F.col("text"), vocabulary("byte_bpe_50k.tiktoken"), split_pattern())
    found = table(spark, sf_dir, "documents").select("doc_id", spans.alias("spans"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(number, secrets.KINDS), F.sha2(told(base), 256).alias("base_sha256"),
                        told(F.col("spans")).alias("spans"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id")) == 1
    scored = lm.score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         "perplexity")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("lang")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, MAX_EPOCHS)
    return mixed.select("doc_id", "size", "source_size", "target", "copies", "part", "taken")


def op10_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with one id are told apart by a hash of their text; of several rows with the next id, the least fingerprint counts.
    The digest goes along as four numbers, so that texts are dealt once."""
    digest = F.sha2("edited", 256)
    parts = {f"digest{n}": F.conv(F.substring(digest, 16 * n + 1, 16), 16, -10).cast("long") for n in range(4)}
    changed = sampling.edited(table(spark, sf_dir, "documents")).select("*", F.xxhash64("text").alias("version"), *[c.alias(n) for n, c in parts.items()])
    found = sampling.fingerprints(changed, ["doc_id", "version"], ["text", "edited"], keep=["next", "n_chars", *parts])
    following = found.groupBy(F.col("doc_id").alias("next")).agg(F.min("text_fingerprint").alias("next_fingerprint"))
    return found.join(following, "next", "left").select(
        "doc_id", "n_chars", F.lower(F.concat(*[F.lpad(F.hex(n), 16, "0") for n in parts])).alias("edited_sha256"),
        F.col("text_fingerprint").alias("fingerprint"), "edited_fingerprint",
        sampling.likeness(F.col("text_fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        sampling.likeness(F.col("text_fingerprint"), F.coalesce("next_fingerprint", F.lit(""))).alias("near_next"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; nulls, empty texts, ties and repeated rows as in `pii.personal_data`."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("pii")).alias("spans"))


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages all conversations and repairs them; nulls, ties and repeated rows as in `dialogue.repair`. A conversation of which
    nothing is left after the damage has zeros, an empty audit and the digest of an empty text."""
    rows = table(spark, sf_dir, "conversations")
    report, turns = dialogue.repair(dialogue.damaged(rows))
    report, hashed = (df.withColumnRenamed("conv_id", name) for df, name in ((report, "r"), (dialogue.digests(turns), "h")))
    every = rows.select("conv_id").distinct()
    found = every.join(report, every["conv_id"].eqNullSafe(report["r"]), "left").join(hashed, every["conv_id"].eqNullSafe(hashed["h"]), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every item; ties, nulls and repeated rows as in `lexical.search`."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_chat": op2_chat,
    "op3_language": op3_language,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_lm": op7_lm,
    "op8_rules": op8_rules,
    "op9_mixing": op9_mixing,
    "op10_sampling": op10_sampling,
    "op11_pii": op11_pii,
    "op12_dialogue": op12_dialogue,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL: dict[str, str] = {
    "op13_lexical": lexical.SEARCH_SQL,
    "op2_chat": chat.CHAT_SQL,
    "op9_mixing": mixing.MIX_SQL.format(documents="documents")
    + "SELECT doc_id, size, source_size, target, copies, part, CAST(copies * size + part AS BIGINT) AS taken FROM copied",
}
