import hashlib
import heapq
import random
import re
import zlib

import pytest

from parcelwise.llm import dialogue
from parcelwise.llm.registry import op12_dialogue

SPACE = "[\x20\x09-\x0D]"
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            out += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def faults(rows):
    """rows: (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        said = re.sub(f"{SPACE}+", "", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """By uniform cost search over whole strings of roles: (cost, audit, lines)."""
    heap, done = [(0, "", 0, "", ())], {}
    while True:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, list(lines)
        state = (at, roles[:1] == "s" and len(roles) == 1, roles[-1:])
        if state in done:
            continue
        done[state] = True

        def go(edit, more, to, role=None, text=None):
            own = roles + role[:1] if role is not None else roles
            if role is None or (role and re.fullmatch(r"s?(ua)*u?", own)):
                heapq.heappush(heap, (cost + more, audit + edit, to, own, lines + ((f"{role}:{text}",) if role is not None else ())))

        for role in ("user", "assistant"):
            go("I", 5, at, role, "")
        if at < len(rows):
            (role, text), fault = rows[at], found[at]
            go("D", 2, at + 1)
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                go("K", late, at + 1, role, text)
                for other in ("user", "assistant"):
                    go("R", 1 + late, at + 1, other, text)


def plain(rows):
    """conv_id -> all that the query returns, from rows in any order without ties."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        said, turns = [(r[2], r[3]) for r in own], [r[1] for r in own if r[1] is not None]
        found = faults(said)
        cost, audit, lines = cheapest(said, found)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = [tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(op12_dialogue(spark, sf_dir)) == plain(rows)


def of(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.selectExpr("*", "'x' AS pos", "1 AS piece", "2 AS c", "'y' AS digest", "3 AS first", "'z' AS letter").write.parquet(f"{tmp_path}/conversations.parquet")
    return op12_dialogue(spark, str(tmp_path))


def test_odd(spark, tmp_path):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "human", "", None, "sales", "ua"]
    texts = ["Yes.", "no", "", None, " \t", "What? ", "a.b", "é!\n", "wirklich?\x0b"]
    rows = [(c, None if t == 3 and c % 5 == 0 else t, rng.choice(roles[:3] if c % 2 else roles), rng.choice(texts) if c % 3 else f"{c}.{t} " + rng.choice(["x.", "y"]))
            for c in range(120) for t in range(rng.randrange(1, 12))]
    rows += [(None, 1, "user", "Hello."), (None, None, "system", "Be."), (None, 2, "assistant", "w" * 300_000 + ".")]
    rows += [(1_000, t, "assistant" if t % 2 else "user", f"{t}.") for t in range(3_000)]
    assert result(of(spark, tmp_path, rows)) == plain(rows)


def test_nothing(spark, tmp_path):
    assert result(of(spark, tmp_path, [])) == {}


def test_repeated_rows(spark):
    """Equal rows with one turn, and a long conversation over many pieces."""
    rows = [(1, 1, "user", "A.")] * 3 + [(1, 2, "assistant", "B.")] * 2
    got = dialogue.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    report = got.report.first()
    assert (report["duplicate"], report["cost"], report["audit"], report["gaps"]) == (3, 6, "KDDKD", 0)
    assert [(r["role"], r["text"]) for r in got.turns.orderBy("pos", "part").collect()] == [("user", "A."), ("assistant", "B.")]


@pytest.mark.parametrize("seed", range(300))
def test_search(seed):
    rng = random.Random(seed)
    kinds = [rng.choice(["s", "u", "a", "t"]) if rng.random() < 0.4 else "ua"[i % 2] for i in range(rng.randrange(0, 14))]
    faulty = [rng.choice(["", "", "blank", "truncated"]) for _ in kinds]
    letters = bytes(ord("A") + 3 * "suat".index(k) + ["", "blank", "truncated"].index(f) for k, f in zip(kinds, faulty))
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    assert dialogue.cheapest(letters) == cheapest([(names[k], "x.") for k in kinds], faulty)[:2]


def test_long_search():
    """Bounds rise only a little, so that the time is in proportion to the rows."""
    rng = random.Random(1)
    letters = bytes(ord("A") + 3 * rng.choice([0, 1, 1, 2, 2, 3]) + rng.choice([0, 0, 0, 1, 2]) for _ in range(100_000))
    cost, audit = dialogue.cheapest(letters)
    assert len(dialogue.told(letters, audit)) == len(letters) and cost > 0
