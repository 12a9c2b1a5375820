import random
import re

import pytest

from pagewright.llm import minhash
from tests.llm.conftest import prose, table


def brute(texts, k, need, of):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (m := len(sets[i] & sets[j])) and m * of >= len(sets[i] | sets[j]) * need:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def copies(seed, n, words=80):
    """Families of copies with a few edits each, near the threshold."""
    rng = random.Random(seed)
    out = []
    for f in range(3):
        base = prose(rng, "aa", words).split(" ")
        for _ in range(n):
            mine = list(base)
            for _ in range(rng.randint(0, 6)):
                mine[rng.randrange(len(mine))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(mine))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("k,need,of", [(3, 85, 100), (5, 80, 100)])
def test_components_near_the_threshold(spark, k, need, of):
    texts = copies(k, 40)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_classes(table(spark, texts), k, (need, of)).collect()}
    assert got == brute(texts, k, need, of)


def test_edges(edge, edge_texts, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_classes(edge).collect()}
    assert got == brute(edge_texts, 3, 85, 100)
    assert minhash.near_classes(nothing).count() == 0


def test_repeated_rows(spark, edge, edge_texts):
    got = minhash.near_classes(edge.unionByName(edge)).collect()
    assert len(got) == 2 * len(edge_texts) and {(r.doc_id, r.component_id) for r in got} == {(i, c) for i, (_, c, _) in brute(edge_texts, 3, 85, 100).items()}


def test_one_doc_id_with_several_texts(spark):
    """Each text is compared, and a link of either text names the smallest doc_id."""
    rng = random.Random(11)
    a, b = prose(rng, "aa", 80), prose(rng, "bb", 80)
    edit = lambda t: " ".join("zz" if i == 40 else w for i, w in enumerate(t.split(" ")))
    rows = spark.createDataFrame([(1, a), (1, b), (3, edit(b)), (4, edit(a)), (None, edit(edit(a))), (None, "other words stand here now")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept, r["first"]) for r in minhash.near_classes(rows).collect()]
    assert sorted(g for g in got if g[0] == 1)[0][:3] == (1, 1, True)
    assert {g[:3] for g in got if g[0] in (3, 4)} == {(3, 1, False), (4, 1, False)}
    assert {g[1:] for g in got if g[0] is None} == {(1, False, False), (None, True, True)}


def test_first_is_one_row_key_of_a_component(spark):
    texts = copies(5, 20)
    got = minhash.near_classes(table(spark, texts)).collect()
    assert all(r["first"] == r.kept for r in got)
