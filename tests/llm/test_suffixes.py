import random

import numpy as np
import pytest

from pagewright.llm import suffixes, transform
from tests.llm.conftest import prose, table


def brute(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - 99):
            if (w := data[s : s + 100]) in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        out[i] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept)
    return out


def found(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.without_repeats(docs).collect()}


def test_edges(edge, edge_texts, nothing):
    assert found(edge) == brute(edge_texts)
    assert suffixes.without_repeats(nothing).count() == 0


@pytest.mark.parametrize("split", [1, 2, 20_000])
def test_shared_passages_with_edits(spark, monkeypatch, split):
    """Passages of odd lengths in many documents, runs of one letter, texts of 99 to 101 bytes; cores of many pieces by their strings."""
    monkeypatch.setattr(suffixes, "SPLIT", split)
    rng = random.Random(7)
    passages = [prose(rng, "aa", 40) for _ in range(3)] + ["ab" * 90, "z" * 300]
    texts = ["q" * 99, "q" * 100, "q" * 101]
    for _ in range(40):
        t = prose(rng, "bb", rng.randint(1, 40))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += p[a : a + rng.randint(50, 260)] + prose(rng, "bb", 3)
        texts.append(t)
    assert found(table(spark, texts)) == brute(texts)


def test_repeated_rows_count_once(spark, edge, edge_texts):
    rows = suffixes.without_repeats(edge.unionByName(edge)).collect()
    want = brute(edge_texts)
    assert len(rows) == 2 * len(edge_texts) and all((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id] for r in rows)


def sorted_suffixes(strings, most):
    """Transform, common prefixes, and (string, length), by sorting."""
    every = sorted((list(t[k:]), i, t[k - 1] if k else transform.END) for i, t in enumerate(strings) for k in range(len(t) + 1))
    common = [0]
    for (a, *_), (b, *_) in zip(every, every[1:]):
        n = 0
        while n < min(len(a), len(b), most) and a[n] == b[n]:
            n += 1
        common.append(n)
    return [c for *_, c in every], common, [(i, len(t)) for t, i, _ in every]


@pytest.mark.parametrize("block", [3, 7, 50, 1 << 20])
def test_transform_and_prefixes(tmp_path, monkeypatch, block):
    """Copies, prefixes and suffixes of each other, strings of one symbol; blocks of a few suffixes. No file stays."""
    monkeypatch.setattr(transform, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(25):
        base = bytes(rng.choice(b"ab") for _ in range(30))
        strings = []
        for _ in range(rng.randint(1, 8)):
            k = rng.randint(0, 20)
            strings.append(base[k : k + rng.randint(1, 20)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 5))))
        data, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(t) for t in strings])
        sizes = np.diff(ends, prepend=0)
        bwt, common = transform.collection(data, ends - sizes, ends, f"file://{tmp_path}", 9)
        want = sorted_suffixes(strings, 9)
        assert (bwt.tolist(), common.tolist()) == want[:2]
        for length, who, at in transform.walked(bwt, sizes):
            assert [want[2][p] for p in at.tolist()] == [(w, length) for w in who.tolist()]
        assert not list(tmp_path.iterdir())


def ordered(rows):
    """Different documents in the order that decides what is earlier: id (null first), then the text's digest."""
    digest = lambda t: int(suffixes.digests(np.frombuffer((t or "").encode(), np.uint8), np.zeros(1, int), np.array([len((t or "").encode())]))[0, 0])
    return sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))


def by_rows(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, tie string, place string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.without_repeats(df).collect()), key=str)
    docs = ordered(rows)
    result = brute([t for _, t in docs])
    want = {doc: result[i] for i, doc in enumerate(docs)}
    assert got == sorted(((d, *want[d, t or ""]) for d, t in rows), key=str)


@pytest.mark.parametrize("split", [1, 20_000])
def test_null_and_repeated_ids(spark, monkeypatch, split):
    monkeypatch.setattr(suffixes, "SPLIT", split)
    rng = random.Random(3)
    a, b, c, d = (prose(rng, "aa", 80) for _ in range(4))
    by_rows(spark, [(None, a + a), (None, b + d), (5, c + c)])
    by_rows(spark, [(1, a + a), (1, b + d), (7, b)])
    by_rows(spark, [(None, a + a), (None, b), (5, c), (6, c + b)])
    by_rows(spark, [(1, a + a), (1, b), (5, c)])


def test_shared_passages_under_few_ids(spark):
    rng = random.Random(8)
    passages = [prose(rng, "aa", 40) for _ in range(3)]
    rows = [(rng.choice([None, 1, 2, 3]), prose(rng, "bb", rng.randint(1, 20)) + (p := rng.choice(passages))[rng.randrange(len(p)) :] + prose(rng, "bb", 3)) for _ in range(40)]
    by_rows(spark, rows + rows[:9] + [(None, None), (1, ""), (None, "")])
