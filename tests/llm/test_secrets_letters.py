import random
import string

import pytest

from parcelwise.llm import secrets
from parcelwise.llm.registry import split_pattern, vocabulary

RANKS, PATTERN = vocabulary("byte_bpe_50k.tiktoken"), split_pattern()


def found(run):
    return [(a, b) for a, b, kind in secrets.spans_of(f"see {run} here", RANKS, PATTERN) if kind == "random"] == [(4, 4 + len(run))]


@pytest.mark.parametrize("letters,least", [(string.ascii_letters, 0.99), (string.ascii_uppercase, 0.95), (string.ascii_lowercase, 0.85)])
def test_letters_alone(letters, least):
    rnd = random.Random(7)
    keys = ["".join(rnd.choice(letters) for _ in range(rnd.randint(16, 40))) for _ in range(400)]
    assert sum(map(found, keys)) >= least * len(keys)


def test_joined_letters():
    rnd = random.Random(8)
    keys = ["-".join("".join(rnd.choice(string.ascii_uppercase) for _ in range(5)) for _ in range(5)) for _ in range(400)]
    assert sum(map(found, keys)) >= 0.98 * len(keys)


def test_identifiers_stay():
    for run in ("HAVE_BROKEN_POLL", "POP_JUMP_IF_TRUE", "DONT_ACCEPT_TRUE_FOR_1", "HAVE_CURSES_IS_TERM_RESIZED", "SIZEOF_UINTPTR_T", "GEORGIAN-ACADEMY",
                "UNPACK_SEQUENCE_TWO_TUPLE", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "4049234910482942", "2026-12-04/00_11_22", "w" * 3000):
        assert not found(run), run
