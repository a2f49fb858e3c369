"""Operator 4: near-duplicates by SimHash, found through Golay codewords near segments of the fingerprint."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.components import components
from parcelwise.llm.shared import in_batches, settled

BITS = 64
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
#: Bits of the three segments; each fits a word of the code.
SEGMENTS = (22, 21, 21)
#: Keys with more fingerprints than this are linked through balls instead of pairs.
PAIRED = 32
SEED = 42
#: Shingles that are hashed and added up at once.
CHUNK = 1 << 16


def _bit_counts(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit set, most significant first; the number of shingles."""
    n = max(len(words) - shingle + 1, 1) if words else 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        parts = [words[i:i + shingle] for i in range(at, min(at + CHUNK, n))]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return counts, n


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the text's word shingles as a signed 64-bit number; 0 where there is no word."""
    counts, n = _bit_counts((text or "").encode().lower().split(), shingle)  # bytes: A-Z, ASCII white space
    bits = np.packbits(2 * counts > n)
    return int(bits.view(">i8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return hashed(text)


def _syndrome(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of weight 3 or less that leads to the nearest codeword, and the (at most five)
    patterns of weight 4 that lead to further codewords, 0 where there is none. Both follow from the generator."""
    units = [_syndrome(1 << i) for i in range(23)]
    nearest, further = np.zeros(2048, np.int32), np.zeros((2048, 5), np.int32)
    found = np.zeros(2048, int)
    for weight in range(1, 5):
        for places in combinations(range(23), weight):
            s = 0
            for i in places:
                s ^= units[i]
            pattern = sum(1 << i for i in places)
            if weight < 4:
                nearest[s] = pattern
            elif int(nearest[s]).bit_count() == 3:
                further[s, found[s]] = pattern
                found[s] += 1
    return nearest, further


@lru_cache
def _unit_syndromes() -> np.ndarray:
    low, high = np.zeros(4096, np.int32), np.zeros(2048, np.int32)
    for i in range(4096):
        low[i] = _syndrome(i)
    for i in range(2048):
        high[i] = _syndrome(i << 12)
    return np.concatenate([low, high])


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (upper 12 bits) of the Golay codewords within distance 4 of 23-bit words, six columns, -1 for none.

    The nearest codeword is at distance 3 or less. Where it is at 3, five more are at 4. Two words that differ in two
    bits or fewer have an index in common."""
    nearest, further = _decoder()
    units = _unit_syndromes()
    s = units[words & 4095] ^ units[4096 + (words >> 12)]
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = (words ^ nearest[s]) >> 11
    for k in range(5):
        pattern = further[s, k]
        out[:, k + 1] = np.where(pattern > 0, (words ^ pattern) >> 11, -1)
    return out


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): all join keys of fingerprints.

    Of two bits that differ, one segment of three has none (pigeonhole). Its bits, together with each codeword near the
    next segment, which has two errors at most, make the keys: up to 18, of 35 bits."""
    prints = prints.astype(np.uint64)
    shifts = np.cumsum((0, *SEGMENTS[:-1]))
    parts = [(prints >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1) for s, n in zip(shifts, SEGMENTS)]
    near = [codewords(p) for p in parts]
    at, out = [], []
    for i in range(3):
        index = near[(i + 1) % 3]
        rows, _ = np.nonzero(index >= 0)
        at.append(rows)
        out.append((np.int64(i) << 34) | (parts[i][rows] << 12) | index[index >= 0])
    return np.concatenate(at), np.concatenate(out)


def _with_keys(batches):
    for batch in batches:
        at, key = keys(batch["fingerprint"].to_numpy())
        yield pd.DataFrame({"fingerprint": batch["fingerprint"].to_numpy()[at], "key": key})


def links(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct `fingerprint`s with at most `max_bits` differing.

    Keys held by up to PAIRED fingerprints are joined and each pair is verified. Fingerprints of a fuller key, of which
    there would be too many pairs, are laid on the points at one bit or none from them: two differ in two bits or fewer
    just if they meet on a point, and a point has 65 visitors at most, who are linked to the least. No link is lost
    either way, and the work per fingerprint is bounded."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the code's keys find links of up to two bits")
    keyed = settled(classes.select("fingerprint").mapInPandas(_with_keys, "fingerprint long, key long"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    few = keyed.join(sizes.filter(F.col("n") <= PAIRED).select("key"), "key")
    differing = F.bit_count(F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint")))
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key"))
                                & (F.col("x.fingerprint") < F.col("y.fingerprint")) & (differing <= max_bits))
    pairs = pairs.select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"))

    many = keyed.join(sizes.filter(F.col("n") > PAIRED).select("key"), "key").select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])
    points = many.select("fingerprint", F.explode(flips).alias("flip")).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("point"))
    if max_bits < 2:  # then a point is met by its own fingerprint, or links are the flips themselves
        points = points.filter((F.col("point") == F.col("fingerprint")) | F.lit(max_bits == 1))
        own = many.select("fingerprint")
        met = points.join(own.withColumnRenamed("fingerprint", "point"), "point")
        stars = met.select(F.col("point").alias("a"), F.col("fingerprint").alias("b"))
    else:
        least = points.groupBy("point").agg(F.min("fingerprint").alias("least"))
        stars = points.join(least, "point").filter("least <> fingerprint").select(
            F.col("least").alias("a"), F.col("fingerprint").alias("b"))
    return pairs.unionByName(stars).filter("a <> b").distinct()


def near_duplicates(df: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(`id_col`, fingerprint, component_id, root, text_hash) for every row of `df`.

    Texts are lower-cased (A-Z), parted at ASCII white space and cut into shingles of `shingle` words, repeats
    included; a shorter text is one shingle. A bit of the 64-bit `fingerprint` (a signed long) is set if more than half
    of the shingles' XXH64 hashes have it. A text without words, also null, has fingerprint 0 and is linked like any
    other. Fingerprints that differ in `max_bits` (0 to 2) or fewer are linked; `component_id` is the least id
    reachable, null if all ids there are null; `root` is a fingerprint that names the group, `text_hash` tells texts apart.

    Equal fingerprints are one class before anything is joined, so copies cost a row each however many they are.
    Repeated rows and ids give repeated rows. An empty table gives an empty table; further columns are ignored."""
    docs = settled(in_batches(df).select(F.col(id_col).alias("_id"), fingerprints(F.col(text_col), shingle).alias("fingerprint"),
                             F.xxhash64(text_col).alias("text_hash")))
    classes = settled(docs.groupBy("fingerprint").agg(F.min("_id").alias("least")))
    roots = settled(components(links(classes, max_bits)))
    rooted = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("fingerprint", "component_id", "root")
    return docs.join(found, "fingerprint").select(F.col("_id").alias(id_col), "fingerprint", "component_id", "root", "text_hash")


def deduplicated(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` of each group of near-duplicates, with all columns: that with the least id (null last, ties by a hash
    of the text, and of equal rows one)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    found = near_duplicates(rows, shingle, max_bits)
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least"))
    chosen = chosen.select(F.col("least.doc_id").alias("least_id"), F.col("least.text_hash").alias("least_hash"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "row").join(
        chosen, F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("text_hash") == F.col("least_hash")), "left_semi")
    return rows.groupBy("doc_id", "text_hash").agg(F.min("row").alias("row")).select("row.*")
