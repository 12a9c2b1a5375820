import random

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import common, words


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(35)] + [(300, 300)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbers_are_gapless_over_buckets(spark):
    rows = [(i % 3, i) for i in range(200)] + [(0, None)] * 4
    got = common.numbered(spark.createDataFrame(rows, "k int, id long"), ["k"], ["id"], "no", 7, "id").collect()
    for k in range(3):
        assert sorted(r.no for r in got if r.k == k) == list(range(sum(x == k for x, _ in rows)))


def test_shingles_equal_those_of_a_plain_split():
    texts = ["A b\tc  d", "", "one", "a b", "b c d e é 😀 x", "a b c d"]
    sets = words.text_shingles(pa.array(texts), 3)
    plain = [t.encode().lower().split() for t in texts]
    want = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()) for w in plain]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


def test_chunks_keep_rows_whole_and_slices_apart():
    texts = pa.array(["a" * 5, None, "b" * 9, "c"]).slice(1)
    got = [(ids.to_pylist(), t.to_pylist()) for ids, t in common.text_chunks([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), texts], ["i", "t"])], 6)]
    assert got == [([1, 2], ["", "b" * 9]), ([3], ["c"])]
    data, offsets = words.raw(texts.fill_null(""))
    assert data.tobytes() == b"b" * 9 + b"c" and offsets.tolist() == [0, 0, 9, 10]


def test_tables_of_a_block_are_dropped_and_no_others(spark):
    outside = common.written(spark.range(3), "outside")
    with common.Tables() as tables:
        inside = common.written(spark.range(4), "inside")
        kept = common.written(spark.range(5), "kept", keep=True)
    assert len(tables.paths) == 1 and inside.count() == 4
    tables.drop(spark)
    assert outside.count() == 3 and kept.count() == 5 and not tables.paths
    with pytest.raises(Exception, match="NOT_EXIST|not exist"):
        inside.agg({"id": "sum"}).collect()


def test_flags_see_few_texts_at_once(spark):
    """Workers of the pipeline's stages hold about FEW_CHARS of text and what is made of it, whatever the batch."""
    import numpy as np

    from pagewright.llm.common import FEW_CHARS, text_flag

    few = lambda texts: np.full(len(texts), len(texts) * 1000 <= FEW_CHARS + 1000)
    rows = spark.range(1000).coalesce(1).selectExpr("repeat('x', 1000) as text")
    assert rows.where(text_flag(few)).count() == 1000
