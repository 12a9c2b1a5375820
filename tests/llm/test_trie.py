import hashlib
import random
import zlib

import pytest

from pagewright.llm import trie
from tests.llm.conftest import CLASHES

SCHEMA = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in (*CLASHES, "depth", "path", "part"))


def plain(rows, heads=trie.HEADS):
    """The whole trie in a dictionary."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        full[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = {}
    for c, ls in full.items():
        for d in range(len(ls) + 1):
            members.setdefault(ls[:d], []).append(c)
    out = []
    for p, m in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        children = [q for q in inside if len(q) == len(p) + 1]
        leaves = sum(not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in inside) for q in inside)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in inside if q)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(full[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([r + ("x",) * (len(CLASHES) + 3) for r in rows], SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_a_dictionary(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 3)
    monkeypatch.setattr(trie, "IDS", 4)
    rng = random.Random(seed)
    rows = []
    for c in list(range(-6, 30)) + [10**12, 10**12 + 3]:
        for t in range(rng.choice([0, 1, 2, 5, 12, 20])):
            turn = None if rng.random() < 0.05 else t // 2 if c % 7 == 0 else t
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(["", None, "é😀", "a", "b", "hello " * 3])))
    rows += [(3, 1, "user", "a")] * 3 + [(None, 0, "user", "lost")]
    rng.shuffle(rows)
    assert found(trie.trie(*trie.rebuilt(table(spark, rows)))) == plain(rows)


def test_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 16)
    monkeypatch.setattr(trie, "IDS", 8)
    rows = [(c, t, "user", f"t{t}") for c in range(60) for t in range(4)] + [(100, t, "bot", str(t)) for t in range(150)] + [(200, t, None, "same") for t in [5] * 40]
    assert found(trie.trie(*trie.rebuilt(table(spark, rows), heads=1))) == plain(rows, 1)


def test_deep_branches_end_in_few_rounds(spark):
    rows = [(c, t, "user", "s" if t < c else f"x{c}") for c in range(40) for t in range(c + 1)]
    assert found(trie.trie(*trie.rebuilt(table(spark, rows), heads=1))) == plain(rows, 1)


def test_empty(spark):
    assert found(trie.trie(*trie.rebuilt(table(spark, [])))) == []
    assert found(trie.trie(*trie.rebuilt(table(spark, [(None, 1, "user", "a")])))) == []
