import math
import re
from collections import Counter

import pytest

from pagewright.llm import backoff


def brute(texts):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    grams = lambda ws: Counter(tuple(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1))
    every = Counter()
    for ws in words:
        every.update(grams(ws))
    total = sum(map(len, words))
    for ws in words:
        mine, n, score, back = grams(ws), max(1, total - len(ws)), 0.0, 0
        count = lambda g: every[g] - mine[g]  # noqa: B023, E731
        for i, w in enumerate(ws):
            for size in range(min(3, i + 1), 0, -1):
                g = tuple(ws[i - size + 1 : i + 1])
                if count(g):
                    score += math.log(count(g) / (count(g[:-1]) if size > 1 else n))
                    break
                back += 1
            else:
                score -= math.log(n)
        yield len(ws), back, score + back * math.log(0.4)


@pytest.mark.parametrize("block", [1 << 24, 1000])
def test_scores(edge, edge_texts, nothing, block, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", block)
    got = {r.doc_id: r for r in backoff.backoff_scores(edge).collect()}
    for i, (n, back, total) in enumerate(brute(edge_texts)):
        assert (got[i].n_words, got[i].n_backoff) == (n, back)
        assert got[i].log_score == pytest.approx(total)
        assert got[i].perplexity == (pytest.approx(math.exp(-total / n)) if n else None)
    assert backoff.backoff_scores(nothing).count() == 0
