import random
import string

import pytest
from pyspark.sql import functions as F

from parcelwise.llm import secrets
from parcelwise.llm.registry import split_pattern, vocabulary

RANKS, PATTERN = vocabulary("byte_bpe_50k.tiktoken"), split_pattern()


@pytest.mark.parametrize("seed", range(5))
def test_the_whole_key_is_told_and_masked(spark, seed):
    rnd = random.Random(seed)
    ends = ["".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(12)) for _ in range(2)]
    with_hex = f"{ends[0]}G{''.join(rnd.choice('0123456789abcdef') for _ in range(24))}Z{ends[1]}"
    with_access = f"AKIA{''.join(rnd.choice(string.ascii_uppercase + string.digits) for _ in range(18))}x{ends[0]}"
    for key, kind in ((with_hex, "hex"), (with_access, "access")):
        found = secrets.spans_of(f"see {key} here", RANKS, PATTERN)
        assert (4, 4 + len(key), "random") in found and kind in {k for _, _, k in found}
        row = spark.createDataFrame([(f"see {key} here",)], "t string").select(secrets.masked(F.col("t"), RANKS, PATTERN).alias("t")).first()
        assert row["t"] == "see [SECRET] here"


def test_covered_runs_stay_with_the_base():
    key = "Xk9Qm2Vt7Lp4Rz8Wd3Hs"
    assert {k for _, _, k in secrets.spans_of(f"token={key} here", RANKS, PATTERN)} == {"assign"}
