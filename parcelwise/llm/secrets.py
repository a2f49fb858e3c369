"""Operator 6: secrets by their form, and random strings by how poorly a vocabulary compresses them."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The base patterns. Matches are taken from the left without overlap, short ones dropped afterwards.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Of `[0-9a-f]+` a whole run matches, so that asking for the least length at once finds the same runs.
LONG_HEX = re.compile(f"[0-9a-f]{{{LEAST['hex']},}}")
#: Kinds in the order in which spans with one start are told.
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
SPANS = "array<struct<kind:string,start:int,end:int>>"

#: A run without a break that may be a key, and the fewest characters of one.
LEAST_RANDOM = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RANDOM},}}")
#: Random letters and digits give 1.0 to 1.8 characters per token, words of any language 2 and more.
MOST_PER_TOKEN = 1.9
#: Known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) in hexadecimal.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
#: Between the parts of an identifier. Its parts are words or numbers; keys mix letters with digits within a part, or letters at random.
JOINTS = re.compile(r"[+/_=-]+")
#: Words in lower case, each by itself, have as many letters per token; random letters hardly ever.
LEAST_PER_WORD = 2.3
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def _encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return found


def _is_known(run: str, encoding) -> bool:
    """Whether the run is a number, a digest, or an identifier: numbers and words that the vocabulary has long tokens for."""
    parts = [part for part in JOINTS.split(run.lower()) if part]
    if all(part.isalpha() or part.isdigit() for part in parts):
        words = [part for part in parts if part.isalpha()]
        tokens = sum(min(len(encoding.encode_ordinary(before + word)) for before in ("", " ")) for word in words)
        return sum(map(len, words)) >= LEAST_PER_WORD * tokens or "".join(words) in ALPHABET
    return bool(DIGEST.fullmatch(run) or UUID.fullmatch(run))


def random_spans(text: str, taken: list[tuple[int, int, str]], encoding) -> list[tuple[int, int, str]]:
    """Runs with few characters per token that are no known digest or identifier; of `taken` they may hold some, but not consist."""
    found, taken, at, near = [], sorted(taken), 0, []
    for m in CANDIDATE.finditer(text):
        near = [span for span in near if span[1] > m.start()]
        while at < len(taken) and taken[at][0] < m.end():
            near, at = near + [taken[at]] * (taken[at][1] > m.start()), at + 1
        covered = m.start()
        for start, end, _ in near:
            if start > covered:
                break
            covered = max(covered, end)
        if covered >= m.end():
            continue
        if len(m[0]) < MOST_PER_TOKEN * len(encoding.encode_ordinary(m[0])) and not _is_known(m[0], encoding):
            found.append((m.start(), m.end(), "random"))
    return found


def spans_of(text: str | None, ranks: str, pattern: str) -> list[tuple[int, int, str]]:
    base = base_spans(text or "")
    return sorted(base + random_spans(text or "", base, _encoding(ranks, pattern)), key=lambda s: (s[0], KINDS.index(s[2])))


def secret_spans(text: Column, ranks: str, pattern: str) -> Column:
    """Spans (kind, start, end) of secrets in whole texts, in code points, by start and kind. Null and empty texts
    have none. `ranks` is the path of a tiktoken vocabulary that every worker can read, `pattern` how it splits text."""
    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t, ranks, pattern)] for t in texts],
                         dtype="object")

    return scan(text)


def masked(text: Column, ranks: str, pattern: str, mask: str = "[SECRET]") -> Column:
    """Texts with every secret replaced; overlapping spans are replaced as one. Null stays null."""
    def mask_one(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for start, end, _ in spans_of(t, ranks, pattern):
            if start >= at:
                out += [t[at:start], mask]
            at = max(at, end)
        return "".join(out) + t[at:] if out else t

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        return pd.Series([mask_one(t) for t in texts], dtype="object")

    return replace(text)
