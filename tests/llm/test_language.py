import random
from collections import Counter

import numpy as np

from pagewright.llm import language
from tests.llm.conftest import prose, table


def training(spark):
    rng = random.Random(9)
    langs = {i: ("aa", "bb")[i % 2] for i in range(60)}
    return table(spark, [prose(rng, langs[i], 60) for i in range(60)], langs)


def test_held_out_accuracy_and_rejection(spark):
    model = language.fit(training(spark))
    rng = random.Random(10)
    texts = [prose(rng, ("aa", "bb")[i % 2], 30) for i in range(30)] + ["q" * 400, None, "", "12 34 !", "KA TO!"]
    got = {r.doc_id: r for r in language.identify(table(spark, texts), model).collect()}
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] and not got[i].rejected for i in range(30))
    assert got[30].rejected and all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (31, 32, 33))
    assert got[34].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())


def plain_kneser_ney(texts, vocabulary):
    """P(symbol | three before) by dictionaries, from the definition: counts at the highest order, numbers of different left neighbours below."""
    padded = [[0, 0, 0] + [ord(c) if c != " " else 0 for c in t] for t in texts]
    tables = {4: Counter(tuple(t[i - 3 : i + 1]) for t in padded for i in range(3, len(t)))}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / vocabulary
        counts = tables[n]
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return max(counts[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * p(gram[1:]) if gram in counts else d * len(after) / sum(after) * p(gram[1:])

    return p


def test_costs_equal_the_definition():
    rng = random.Random(12)
    texts = [prose(rng, "aa", 8) for _ in range(6)]
    symbols = [np.array([0, 0, 0] + [ord(c) if c != " " else 0 for c in t], np.uint64) for t in texts]
    codes = np.concatenate([[sum(int(s[i - k]) << 16 * k for k in range(4)) for i in range(3, len(s))] for s in symbols]).astype(np.uint64)
    seen, n = np.unique(codes, return_counts=True)
    vocabulary = len({int(c) & 0xFFFF for c in seen.tolist()}) + 1
    hashes, logs, weights, floor = language.kneser_ney(seen, n, vocabulary)
    model = language.Model(["aa"], [hashes], [logs], [weights], [floor])
    p = plain_kneser_ney(texts, vocabulary)
    letters = sorted({int(c) & 0xFFFF for c in seen.tolist()}) + [ord("q")]
    grams = [tuple(rng.choice(letters) for _ in range(4)) for _ in range(200)] + [tuple(int(c) >> 16 * k & 0xFFFF for k in (3, 2, 1, 0)) for c in seen[:60].tolist()]
    cost = model.cost(np.array([sum(s << 16 * (3 - i) for i, s in enumerate(g)) for g in grams], np.uint64))[:, 0]
    assert np.allclose(cost, [-np.log2(p(g)) for g in grams], atol=1e-4)
    for context in {g[:3] for g in grams[:40]}:  # all symbols and one unseen
        assert abs(sum(p((*context, s)) for s in letters) - 1) < 1e-9


def test_edges(spark, edge, edge_texts, nothing):
    model = language.fit(training(spark))
    assert language.identify(edge, model).count() == len(edge_texts) and language.identify(nothing, model).count() == 0
    untaught = language.fit(nothing)
    assert {r.lang_pred for r in language.identify(edge, untaught).collect()} == {"und"}
