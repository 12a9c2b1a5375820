import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import resample
from tests.llm.conftest import prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for doc, text in rows:
        n, fs = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in fs)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: 5 * len(able) // 100]


def check(spark, df, rows, target):
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = resample.importance_sample(df, bench).collect()
    out, drawn = plain(rows, target)
    key = lambda r: tuple(-1 if x is None else x for x in r[:5])
    assert sorted(map(key, got)) == sorted(map(key, out))
    assert [key(r) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [key(r) for r in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_edge_cases(spark, edge, edge_texts, nothing):
    rng = random.Random(2)
    target = [prose(rng, "aa", 60), None, "", "One two THREE one two three"]
    check(spark, edge, list(enumerate(edge_texts)), target)
    check(spark, edge, list(enumerate(edge_texts)), [])
    assert resample.importance_sample(nothing, nothing).count() == 0


@pytest.mark.parametrize("places", [7, 1 << 18])
def test_ties_and_repeats(spark, monkeypatch, places):
    monkeypatch.setattr(resample, "PLACES", places)
    rng = random.Random(places)
    one = prose(rng, "aa", 30)
    texts = [prose(rng, rng.choice(["aa", "bb"]), rng.choice([1, 2, 19, 20, 21, 50])) for _ in range(150)] + [one] * 50
    rows = [(i if i < 150 else 7 if i < 190 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, part string, at string")
    check(spark, df, rows, [prose(rng, "aa", 40)])


def test_suffix_arrays_in_slices_give_the_same_buckets(monkeypatch):
    rng = random.Random(1)
    texts = pa.array([prose(rng, "aa", rng.choice([0, 1, 2, 3, 40])) for _ in range(60)] + ["a b a b a b a b", "", "é É a\x00b"], pa.string())
    whole, bounds = resample.feature_buckets(texts)
    for text, a, b in zip(texts.to_pylist(), bounds[:-1], bounds[1:]):
        assert Counter(whole[:, a:b].ravel().tolist()) - Counter({resample.BUCKETS: 9**9}) == Counter(features(text)[1])
    monkeypatch.setattr(resample, "PLACES", 5)
    assert np.array_equal(resample.feature_buckets(texts)[0], whole)


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 4, 200)
    left = 200 - np.arange(200)
    order, common = resample.suffix_array(ids, left)
    parts = [tuple(ids[i : i + 3]) for i in order]
    assert parts == sorted(parts)
    assert all(c == next((k for k in range(3) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 3) for a, b, c in zip(parts, parts[1:], common[1:]))
